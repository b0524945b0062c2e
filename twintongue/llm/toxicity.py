"""Toxicity by two class-conditional Kneser-Ney models.

Words are runs of letters and digits in lower case. In both classes, toxic and
ordinary, a word counts as often as different words stand before it (continuation
counts, so that copies of a text count once). The absolutely discounted counts back
off to those of the word's beginning (STEM letters) in the class, and these to
counts that both classes share: a rare expression is no evidence by itself. A
document's two log-likelihoods are compared, normalised by length, over the whole
text and over its one and its three most telling different words; a logistic curve
makes a probability of them. The curve is fitted on a part of the labelled
documents with counts of the others; then all are counted.

Learning takes a bounded sample of labelled rows (about MOST_TOXIC and
MOST_ORDINARY documents, drawn by a hash of doc_id; whole texts). The model is a
few arrays of fixed size (8 MB), which are broadcast. Scoring is a map over all
documents without a shuffle.

Defined results: null and empty texts have the score of a text without evidence;
contradicting labels of a doc_id count as the highest; null labels and labels of a
null doc_id are not read; without labels of both classes all scores are 0; repeated
rows have equal scores; other columns are kept as they are, and where one is called
score or predicted, the operator's own column has underscores behind that name; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of, fresh, give_back, sliced, small_batches

MOST_TOXIC, MOST_ORDINARY = 5000, 12_000
BITS = 19
DISCOUNT = 0.9
STEM = 4
THRESHOLD = 0.3


class Words:
    """The words of texts as slots of their own and of their beginnings; offs: where each text's words begin and end."""

    def __init__(self, texts: pa.Array):
        import xxhash

        if texts.null_count:
            texts = texts.fill_null("")
        clean = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string())), r"[^\p{L}\p{N}]+", " ")
        lists = pc.ascii_split_whitespace(clean)
        words, offs = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        full = pc.not_equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
        self.offs = np.concatenate([[0], np.cumsum(full)])[offs - offs[0]]
        coded = words.filter(pa.array(full)).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy(zero_copy_only=False)
        slot = lambda x: xxhash.xxh64_intdigest(x) >> (64 - BITS)
        own, begin = np.fromiter(map(slot, known), np.int64, len(known)), np.fromiter((slot("^" + w[:STEM]) for w in known), np.int64, len(known))
        self.word, self.stem = (x[at] if len(known) else np.zeros(0, np.int64) for x in (own, begin))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(word before << BITS | word) and (word before << BITS | beginning) of each word; before the first stands slot 0."""
        before = np.concatenate([[0], self.word[:-1]]) if len(self.word) else self.word
        before[self.offs[:-1][np.diff(self.offs) > 0]] = 0
        return before << BITS | self.word, before << BITS | self.stem


class Model:
    """Continuation counts by slot; index 0 is the ordinary class, 1 the toxic one."""

    def __init__(self, words: list[np.ndarray], stems: list[np.ndarray]):
        """Different keys (see Words) of each class."""
        count = lambda keys: np.bincount(keys & (1 << BITS) - 1, minlength=1 << BITS).astype(np.float32)
        self.word, self.stem = (np.stack([count(k) for k in x]) for x in (words, stems))

    @staticmethod
    def _level(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Discounted shares, what each class leaves for the next level, and the shared distribution."""
        total, both = np.maximum(k.sum(1, keepdims=True), 1), k.sum(0)
        left = np.where(k.sum(1, keepdims=True) > 0, DISCOUNT * (k > 0).sum(1, keepdims=True) / total, 1)
        return np.maximum(k - DISCOUNT, 0) / total, left, (both + 0.5) / (both.sum() + 0.5 * len(both))

    def ready(self) -> None:
        self.own, self.left, self.shared = self._level(self.word)
        own, left, self.begun = self._level(self.stem)
        self.behind = own + left * self.begun

    def evidence(self, w: Words) -> np.ndarray:
        """Of each word, by how much the toxic class's log-probability is above the ordinary one's."""
        inside = self.shared[w.word] / self.begun[w.stem]
        p = self.own[:, w.word] + self.left * self.behind[:, w.stem] * inside
        return np.log(p[1]) - np.log(p[0])

    def features(self, w: Words) -> np.ndarray:
        """Of each text, the evidence a word over: the whole text, its most telling word, its three most telling different words."""
        lens = np.diff(w.offs)
        out, e = np.zeros((len(lens), 3)), self.evidence(w)
        full = lens > 0
        if full.any():
            sums = np.concatenate([[0], np.cumsum(e)])
            out[:, 0] = (sums[w.offs[1:]] - sums[w.offs[:-1]]) / np.maximum(lens, 1)
            text = np.repeat(np.arange(len(lens)), lens)
            order = np.lexsort((w.word, -e, text))
            new = np.ones(len(e), bool)
            new[1:] = (w.word[order][1:] != w.word[order][:-1]) | (text[order][1:] != text[order][:-1])
            order = order[new]
            text = text[order]
            place = np.arange(len(order)) - np.searchsorted(text, text)
            for most, column in ((1, 1), (3, 2)):
                top = order[place < most]
                of = text[place < most]
                out[:, column] = np.bincount(of, e[top], len(lens)) / np.maximum(np.bincount(of, minlength=len(lens)), 1)
        return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients (the last is the intercept) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
    return mean, scale, beta


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model and curve, from rows text, toxic, calibrates, weight."""
    import pickle

    import zstandard

    keys = {(cal, c, k): [] for cal in (False, True) for c in (0, 1) for k in (0, 1)}
    waiting, later = 0, []

    def merge() -> None:
        for at, parts in keys.items():
            keys[at] = [np.unique(np.concatenate(parts))] if parts else []

    for b in sliced(batches, "text"):
        w = Words(col_of(b, "text"))
        own = w.keys()
        each = np.diff(w.offs)
        toxic, cal, weight = (np.array(col_of(b, c).to_pylist()) for c in ("toxic", "calibrates", "weight"))
        for at in keys:
            mine = np.repeat((toxic == at[1]) & (cal == at[0]), each)
            keys[at].append(own[at[2]][mine])
        waiting += len(w.word)
        if waiting > 2_000_000:
            merge()
            waiting = 0
        if cal.any():
            later.append((col_of(b, "text").filter(pa.array(cal)), toxic[cal], weight[cal]))
    merge()
    of = lambda c, k, cals: np.unique(np.concatenate([*(x for cal in cals for x in keys[cal, c, k]), np.zeros(0, np.int64)]))
    part = Model(*([of(c, k, (False,)) for c in (0, 1)] for k in (0, 1)))
    part.ready()
    curve = None
    if len({int(t) for _, ts, _ in later for t in ts}) == 2:
        x = np.concatenate([part.features(Words(t)) for t, _, _ in later])
        curve = _fit(x, np.concatenate([t for _, t, _ in later]).astype(float), np.concatenate([w for _, _, w in later]))
    model = Model(*([of(c, k, (False, True)) for c in (0, 1)] for k in (0, 1)))
    data = zstandard.ZstdCompressor(3).compress(pickle.dumps((model.__dict__, curve), protocol=4))
    yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["model"])
    del keys, later, part, model, data
    give_back()


def remainder(id_col: str):
    """crc32 of the id as text, modulo 4: 2 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY) -> bytes | None:
    """The packed model; None without labels of both classes. Documents with the remainder 2 are never read."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("rem", remainder("doc_id")).where("rem <> 2 and toxic in (0, 1)")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    of = F.when(F.col("toxic") == 1, F.lit(min(1.0, most_toxic / n[1]))).otherwise(F.lit(min(1.0, most_ordinary / n[0])))
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(chance < of).select(F.col("doc_id").alias("_id"), "toxic", (F.col("rem") == 3).alias("calibrates"), (1 / of).alias("weight"))
    sample = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    got = sample.select("text", "toxic", "calibrates", "weight").repartition(1).mapInArrow(_train, "model binary").collect()
    return bytes(got[0]["model"]) if got else None


def score(docs: DataFrame, packed: bytes | None, text_col: str = "text") -> DataFrame:
    """docs and, after their own columns, score (0 to 1) and predicted (1 from THRESHOLD on)."""
    names = [fresh(n, docs.columns) for n in ("score", "predicted")]
    if packed is None:
        return docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1]))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import zstandard

        model = Model.__new__(Model)
        model.__dict__, curve = pickle.loads(zstandard.ZstdDecompressor().decompress(sent.value))
        model.ready()
        for b in sliced(batches, text_col):
            x = model.features(Words(col_of(b, text_col)))
            if curve is None:  # too few labels for a curve: the most telling words alone
                p = 1 / (1 + np.exp(-np.clip(x[:, 2] - 3, -30, 30)))
            else:
                mean, scale, beta = curve
                p = 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], [*b.schema.names, *names])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    return docs.mapInArrow(run, schema)
