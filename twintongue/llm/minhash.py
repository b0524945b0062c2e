"""Near-duplicates by ProbMinHash over word shingles.

A text's shingles are its runs of five words (fewer words are one shingle), each
of weight 1 however often it occurs, as links count sets. Each shingle sends a
Poisson process of arrivals at the rate of its weight to random registers of the
text's signature, and every register keeps its first arrival; a process ends as
soon as its next arrival comes after all registers' (early termination). Equal
registers of two texts then estimate their probability Jaccard, which at equal
weights is the Jaccard similarity of the sets: what links are judged by.

Equal texts are one class from the start. Classes with an equal band of registers
are candidates; a pair is a link if the Jaccard similarity of its shingle sets,
computed from the texts, is at least `similarity` (the estimate only spares pairs
of a bucket that are 7 standard deviations below). Instead of all pairs of a bucket, each
member is compared with the bucket's most central one, and the linked become
components. In buckets that still hold several components, similar pairs may be
left: these share one of the rarest size - ceil(similarity * size) + 1 shingles of
either text, so the members meet again by those, and all pairs of different
components that do are compared. (Texts that have a common passage alone meet in
buckets, but not by their rare shingles.) Components are found by hooking and
pointer jumping on DataFrames, written to the shared folder in every round.

A class is named by a 64-bit hash of its text (two different texts share one with
probability 3e-20). Defined results: texts without words, null included, are one
class of copies each by their exact text (null counts as empty); a null doc_id
stays null; repeated rows are members like others; other columns are kept as they
are, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, batch_of, col_of, give_back, kept, sliced, small_batches, together, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Below this estimate no exact comparison is made.
LEAST_ESTIMATE = 0.6
#: So many ids at most are broadcast (16 bytes each).
BROADCAST = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each different shingle, in order of text and hash."""
    import xxhash

    if texts.null_count:
        texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    words = lists.flatten()
    offs = lists.offsets.to_numpy().astype(np.int64)
    offs = offs - offs[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    words, offs = words.filter(pa.array(full)), before[offs]
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)
    lens = np.diff(offs)
    text = np.repeat(np.arange(len(lens)), lens)
    left = np.repeat(offs[1:], lens) - np.arange(len(w))  # words from here to the text's end
    h = np.zeros(len(w), np.uint64)
    for j in range(size):
        nxt = np.zeros(len(w), np.uint64)
        if len(w) > j:
            nxt[: len(w) - j] = w[j:]
        h = mixed(h + np.where(left > j, nxt, np.uint64(j + 1)))
    first = np.arange(len(w)) == np.repeat(offs[:-1], lens)
    keep = (left >= size) | first
    text, h = text[keep], h[keep]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(n: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """n by registers: the shingle (16 bits of its hash) that came first in each register; 0 in texts without shingles."""
    time = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint16)
    rate = weight.astype(np.float64)
    now = np.zeros(len(h))
    name = (mixed(h + np.uint64(77)) >> np.uint64(48)).astype(np.uint16)
    live, k = np.arange(len(h)), 0
    while len(live):
        k += 1
        x = mixed(h[live] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        now[live] += -np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate[live]
        slot = text[live] * registers + (mixed(x) % np.uint64(registers)).astype(np.int64)
        t = now[live]
        np.minimum.at(time, slot, t)
        won = t == time[slot]
        who[slot[won]] = name[live[won]]
        latest = time.reshape(n, registers).max(1)
        live = live[now[live] < latest[text[live]]]
    return who.reshape(n, registers)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact; ha and hb are sorted and without repeats."""
    if not len(ha) or not len(hb):
        return 1.0 if len(ha) == len(hb) else 0.0
    every = np.union1d(ha, hb)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, ha)], b[np.searchsorted(every, hb)] = wa, wb
    pairs, count = np.unique(np.stack([a, b])[:, (a > 0) & (b > 0)], axis=1, return_counts=True)
    kinds, many = np.unique(np.stack([a, b]), axis=1, return_counts=True)
    return float(sum(c / (many * np.maximum(kinds[0] / x, kinds[1] / y)).sum() for (x, y), c in zip(pairs.T, count)))


def jaccard(ha: np.ndarray, hb: np.ndarray) -> float:
    both = len(np.intersect1d(ha, hb, assume_unique=True))
    return both / max(1, len(ha) + len(hb) - both)


_SIG = pa.schema([("_id", pa.int64()), ("_node", pa.int64()), ("_sig", pa.binary())])


def node(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, registers: int = BANDS * ROWS) -> DataFrame:
    """_id, _node (a hash of the text) and _sig of each document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), node(text_col).alias("_node"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_text", 2 << 20):
            text, h, _ = shingles(col_of(b, "_text"), size)
            sig = prob_min_hash(b.num_rows, text, h, np.ones(len(h)), registers)
            yield batch_of(_SIG, [col_of(b, "_id"), col_of(b, "_node"), [x.tobytes() for x in sig]])
        give_back()

    return rows.mapInArrow(run, "_id long, _node long, _sig binary")


_BAND = pa.schema([("_band", pa.int64()), ("_node", pa.int64())])


def _bands(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(col_of(b, "_sig").to_pylist()), np.uint16).reshape(b.num_rows, bands, rows).astype(np.uint64)
            h = np.zeros((b.num_rows, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                h = mixed(h + sig[:, :, r] + np.uint64(1))
            yield batch_of(_BAND, [h.ravel().view(np.int64), np.repeat(col_of(b, "_node").to_numpy(), bands)])

    return classes.select("_node", "_sig").mapInArrow(run, "_band long, _node long")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose registers agree at least so often."""
    def side(c: str) -> DataFrame:
        return classes.select(F.col("_node").alias(c), F.col("_sig").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(col_of(b, c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            near = pa.array((x == y).mean(1) >= least)
            yield batch_of(_PAIR, [col_of(b, c).filter(near) for c in ("a", "b")])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _only(rows: DataFrame, ids: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """rows whose column `name` is (left_anti: is not) in ids: by broadcast if these are few, else by a shuffle."""
    few = ids.limit(BROADCAST + 1).count() <= BROADCAST
    return rows.join(F.broadcast(ids) if few else ids, name, how)


_RARE = pa.schema([("_node", pa.int64()), ("_size", pa.int64()), ("_h", pa.int64())])


def _rarest(docs: DataFrame, nodes: DataFrame, text_col: str, size: int, similarity: float) -> DataFrame:
    """_node, _size and, a row for each, the rarest shingles _h of the nodes' texts of which a similar text must have one, with their place _at in order of frequency."""
    texts = docs.select(node(text_col).alias("_node"), F.coalesce(text_col, F.lit("")).alias("_text"))
    texts = _only(texts, nodes.select("_node"), "_node").groupBy("_node").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_text"):
            text, h, _ = shingles(col_of(b, "_text"), size)
            yield batch_of(_RARE, [col_of(b, "_node").to_numpy()[text], np.bincount(text, minlength=b.num_rows)[text], h.view(np.int64)])
        give_back()

    each = written(texts.mapInArrow(run, "_node long, _size long, _h long"), "minhash-shingles")
    often = each.groupBy("_h").agg(F.count(F.lit(1)).alias("_often")).where("_often > 1")
    # A shingle that one text alone has is rarer than all others and meets nothing: the rest of the prefix is what counts.
    common = each.join(written(often, "minhash-common"), "_h")
    rank = F.row_number().over(Window.partitionBy("_node").orderBy("_often", "_h"))
    shared = Window.partitionBy("_node")
    least = F.col("_size") - F.ceil(F.col("_size") * similarity - 1e-9) + 1
    own = F.col("_size") - F.count(F.lit(1)).over(shared)
    return common.withColumn("_at", rank + own).where(F.col("_at") <= least).select("_node", "_size", "_h", "_at")


def links(near: DataFrame, docs: DataFrame, text_col: str, size: int, similarity: float) -> DataFrame:
    """The pairs a, b that are similar, by their texts."""
    ids = written(near.select(F.col("a").alias("_node")).union(near.select("b")).distinct(), "minhash-ids")
    texts = docs.select(node(text_col).alias("_node"), F.coalesce(text_col, F.lit("")).alias("_text"))
    texts = written(_only(texts, ids, "_node").groupBy("_node").agg(F.first("_text").alias("_text")), "minhash-texts")

    def side(c: str) -> DataFrame:
        return texts.select(F.col("_node").alias(c), F.col("_text").alias(f"t{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "ta"):
            got = []
            for c in ("ta", "tb"):
                text, h, _ = shingles(col_of(b, c), size)
                cut = np.searchsorted(text, np.arange(b.num_rows + 1))
                got.append([h[i:j] for i, j in zip(cut[:-1], cut[1:])])
            near = pa.array([jaccard(x, y) >= similarity for x, y in zip(*got)])
            yield batch_of(_PAIR, [col_of(b, c).filter(near) for c in ("a", "b")])
        give_back()

    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """_node, _root (the smallest node of its component) of every node of edges a, b."""
    both = edges.select(F.col("a").alias("_node"), F.col("b").alias("_other")).union(edges.select("b", "a"))
    both = written(both.distinct(), "components-edges")
    labels = written(both.groupBy("_node").agg(F.least("_node", F.min("_other")).alias("_root")), "components")
    while True:
        other = labels.select(F.col("_node").alias("_other"), F.col("_root").alias("_o"))
        least = both.join(other, "_other").groupBy("_node").agg(F.min("_o").alias("_m"))
        hooked = labels.join(least, "_node").select("_node", F.col("_root").alias("_was"), F.least("_root", "_m").alias("_r"))
        up = labels.select(F.col("_node").alias("_r"), F.col("_root").alias("_up"))
        following = written(hooked.join(up, "_r").select("_node", F.least("_r", "_up").alias("_root"), (F.least("_r", "_up") < F.col("_was")).alias("_moved")), "components")
        labels = following.select("_node", "_root")
        if following.where("_moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """_id, _node, class_id (the smallest id of the document's group), group_size, _root (which names the group)."""
    sigs = kept(signatures(docs, id_col, text_col, size, bands * rows))
    classes = written(sigs.groupBy("_node").agg(F.first("_sig").alias("_sig"), F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies")), "minhash-classes")
    # Texts without words have no shingles and are copies of equal texts only.
    members = _bands(classes.where(F.col("_sig") != F.lit(bytes(bands * rows * 2))), bands, rows)
    shared = members.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = written(members.join(shared, "_band").select("_band", "_node", "_n"), "minhash-met")
    # A bucket is compared with its most central member: that which meets most others over all bands, as an original does of its edited copies.
    central = met.groupBy("_node").agg(F.sum("_n").alias("_meets"))
    pivots = met.join(central, "_node").groupBy("_band").agg(F.max(F.struct("_meets", "_node"))["_node"].alias("_pivot"))
    buckets = written(met.join(written(pivots, "minhash-pivots"), "_band").select("_band", "_node", "_pivot"), "minhash-buckets")
    spoken = buckets.select("_node").distinct()
    signed = written(classes.join(spoken, "_node", "left_semi").select("_node", "_sig"), "minhash-signed")
    stars = written(buckets.where("_node <> _pivot").select(F.col("_pivot").alias("a"), F.col("_node").alias("b")).distinct(), "minhash-stars")
    likely = kept(_estimated(stars, signed, min(LEAST_ESTIMATE, similarity - 0.2)))
    found = written(links(likely, docs, text_col, size, similarity), "minhash-links")
    roots = components(found)
    rest = buckets.join(roots, "_node", "left").select("_band", "_node", F.coalesce("_root", "_node").alias("_root"))
    several = rest.groupBy("_band").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo <> _hi").select("_band")
    open_ = written(rest.join(several, "_band", "left_semi").select("_node", "_root").distinct(), "minhash-open")
    rest = written(_rarest(docs, open_, text_col, size, similarity).join(open_, "_node"), "minhash-rarest")
    # Of the components that share a shingle, the members of all but the largest meet all others.
    tally = rest.groupBy("_h", "_root").agg(F.count(F.lit(1)).alias("_k"))
    several = tally.groupBy("_h").agg(F.count(F.lit(1)).alias("_roots"), F.max(F.struct("_k", "_root"))["_root"].alias("_main")).where("_roots > 1")
    rest = written(rest.join(several, "_h").select("_h", "_node", "_root", "_main", "_size", "_at"), "minhash-mixed")
    outside = rest.where("_root <> _main").select("_h", F.col("_node").alias("x"), F.col("_root").alias("rx"), F.col("_size").alias("sx"), F.col("_at").alias("ax"))
    inside = rest.select(F.col("_h").alias("_g"), F.col("_node").alias("y"), F.col("_root").alias("ry"), F.col("_size").alias("sy"), F.col("_at").alias("ay"))
    # If this is the first shingle that both have, only those from here on can be common: enough of them must be left.
    left = F.least(F.col("sx") - F.col("ax"), F.col("sy") - F.col("ay")) + 1
    enough = left >= (F.col("sx") + F.col("sy")) * (similarity / (1 + similarity)) - 1e-9
    cross = outside.join(inside, (F.col("_h") == F.col("_g")) & (F.col("rx") != F.col("ry")) & enough)
    cross = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    cross = written(cross, "minhash-cross")
    if not cross.isEmpty():
        more = links(cross, docs, text_col, size, similarity)
        roots = components(written(found.union(more), "minhash-all-links"))
    named = classes.join(roots, "_node", "left").select("_node", F.coalesce("_root", "_node").alias("_root"), "_first", "_copies")
    groups = named.groupBy("_root").agg(F.min("_first").alias("class_id"), F.sum("_copies").alias("group_size"))
    named = named.join(groups, "_root").select("_node", "class_id", "group_size", "_root")
    return sigs.select("_id", "_node").join(named, "_node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each group."""
    grouped = written(near_duplicates(docs, id_col, text_col, **options), "minhash-groups")
    first = grouped.where(F.col("_id").eqNullSafe(F.col("class_id")))
    gone = grouped.where(~F.col("_id").eqNullSafe(F.col("class_id"))).select("_node", "_id").distinct()
    key = F.struct(F.col(id_col).cast("long").alias("_id"), node(text_col).alias("_node")).alias("_key")
    rows = _only(docs.select(apart(docs), key), gone.select(F.struct("_id", "_node").alias("_key")), "_key", "left_anti")
    doubled = first.groupBy("_root").count().where("count > 1")
    if not doubled.isEmpty():  # repeated ids: one row of each group stays
        one = first.groupBy("_root").agg(F.min("_node").alias("_stays")).select("_stays")
        rows = rows.join(one, F.col("_key._node") == F.col("_stays"), "left_semi").dropDuplicates(["_key"])
    return rows.select(*together(docs))
