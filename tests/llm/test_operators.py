"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twintongue.llm import chat, media, minhash, mixing, mixture, packing, spotsigs, store, suffix, tokens, toxicity

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score string, class_id int, size string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(n))


LONG = prose(9, 30_000)
ROWS = [
    (1, prose(1, 120), "a"), (2, prose(1, 120), "a"), (3, prose(1, 119) + " other", None), (4, None, "b"), (5, "", "b"), (None, prose(2, 80), "b"), (7, prose(3, 10), "c"),
    (7, prose(3, 10), "c"), (7, prose(4, 60), "c"), (8, LONG, "c"), (9, " \n\t ", "d"), (10, "é" * 300, "d"), (11, prose(5, 50) + prose(1, 60), "a"), (12, "two words", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "en", len(t or ""), "x", 1, "y") for i, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, none):
    raw = [(t or "").encode() for _, t, _ in ROWS]
    seen = {}
    for t in raw:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    want = []
    for (i, _, _), t in zip(ROWS, raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((i, len(t), int(gone.sum()), runs, kept))
    for hot in (suffix.HOT, 0):  # 0: all windows go the way of crowded hashes
        got = [(r["doc_id"], r["_n_bytes"], r["_n_removed"], r["_n_spans"], bytes(r["_kept"])) for r in suffix.dedup(docs, hot=hot).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    cut = suffix.dedup(docs, as_text=True)
    assert cut.columns[: len(docs.columns)] == docs.columns and cut.where("doc_id = 4").first()["text"] is None
    assert suffix.dedup(none).count() == 0


def test_minhash(docs, none):
    got = {}
    for r in minhash.near_duplicates(docs).collect():
        got.setdefault(r["_id"], set()).add((r["class_id"], r["group_size"]))
    assert got[1] == got[2] == got[3] == {(1, 3)}
    assert got[4] == got[5] == {(4, 2)} and got[9] == {(9, 1)}
    assert got[7] == {(7, 2), (7, 1)} and got[None] == {(None, 1)}
    kept = minhash.keep_one(docs)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 4, None, 7, 7, 8, 9, 10, 11, 12], key=repr) and kept.columns == docs.columns
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_minhash_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = [prose(100 + k, 60).split() for k in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(rng.integers(0, 5)):
                t[rng.integers(0, len(t))] = "new" + str(rng.integers(0, 99))
            texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import pyarrow as pa

    text, h, w = minhash.shingles(pa.array(texts))
    sets = [h[text == i] for i in range(len(texts))]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if minhash.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_a_repeated_line_makes_no_near_duplicate(spark):
    line = "this very common line is everywhere \n"
    docs = spark.createDataFrame([(i, line * 40 + prose(300 + i, 150)) for i in range(6)], "doc_id long, text string")
    assert minhash.near_duplicates(docs).where("group_size > 1").count() == 0


def test_a_passage_repeated_in_one_of_two_copies_hides_no_link(spark):
    """Pairs of set Jaccard 0.8 or more whose passage occurs 50 or 100 times in one text and once in the other."""
    import pyarrow as pa

    texts = []
    for k in range(8):
        for own, passage, times, edits in ((400, 150, 100, 4), (60, 20, 50, 0), (200, 60, 50, 2)):
            words, line = prose(500 + 10 * k + own, own).split(), " " + prose(900 + 10 * k + own, passage)
            edited = [f"new{i}" if i in range(9, 9 + 40 * edits, 40) else w for i, w in enumerate(words)]
            texts += [" ".join(words) + line * times, " ".join(edited) + line]
    text, h, _ = minhash.shingles(pa.array(texts))
    assert all(minhash.jaccard(h[text == i], h[text == i + 1]) >= 0.8 for i in range(0, len(texts), 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_token_store(spark, docs, none):
    enc = tokens.shared_encoder(tokens.tokenizer_path())
    path = store.write(docs)
    got = store.read(spark, path, with_ids=True).collect()
    want, at = [], 0
    ids_of = lambda t: [*enc.tok.encode(t or "", add_special_tokens=False).ids, 2]
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((i for i, _, _ in ROWS), key=lambda i: -1 if i is None else i)
    for r in order:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
        want.append((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert sorted(want, key=repr) == sorted([(i, ids_of(t)) for i, t, _ in ROWS], key=repr)
    table = spark.read.parquet(path + "/packs").where("kind = 0")
    held, all_ = sum(sum(r["held"]) for r in table.select("held").collect()), sum(len(r["held"]) for r in table.select("held").collect())
    assert held < all_  # equal chunks are stored once
    assert store.read(spark, store.write(none)).count() == 0


def test_token_store_finds_changes(spark, docs):
    path = store.write(docs.where("doc_id in (1, 8, 11)"))
    rows, manifest = spark.read.parquet(path + "/packs"), spark.read.parquet(path + "/manifest")
    broken = F.when(F.col("doc_id") == 8, F.concat(F.substring("data", 1, 500), F.lit(b"\x01"), F.expr("substring(data, 502)"))).otherwise(F.col("data"))
    pack = manifest.where("n_docs > 0 and pack is not null").first()["pack"]
    cases = {
        "changed": (rows.withColumn("data", broken), manifest),
        "short": (rows.where("doc_id is null or doc_id <> 1"), manifest),
        "pack": (rows.where(F.col("pack") != pack), manifest),
        "list": (rows, manifest.where(F.col("pack").isNull() | (F.col("pack") != pack))),
        "root": (rows, manifest.withColumn("root", F.when(F.col("pack").isNull(), F.lit(b"0" * 32)).otherwise(F.col("root")))),
    }
    for name, (r, m) in cases.items():
        r.write.parquet(f"{path}-{name}/packs")
        m.write.parquet(f"{path}-{name}/manifest")
        with pytest.raises(Exception, match="changed|manifest|follow"):
            store.read(spark, f"{path}-{name}").count()
    assert store.read(spark, path).count() == 3


def test_packing(docs, none):
    enc = tokens.shared_encoder(tokens.tokenizer_path())
    ids_of = lambda t: [*enc.tok.encode(t or "", add_special_tokens=False).ids, 1]
    rows = packing.pack(docs, limits=packing.Limits(256, 8, 256)).collect()
    assert sorted((r["doc_id"] for r in rows if r["start"] == 0), key=repr) == sorted((i for i, _, _ in ROWS), key=repr)
    for i, t, _ in ROWS:
        if i != 7:
            mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
            ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist()
            assert ids == ids_of(t) and {r["doc_tokens"] for r in mine} == {len(ids)}
    seven = sum(len(ids_of(t)) for i, t, _ in ROWS if i == 7)
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == seven
    filled(rows, 256)
    assert packing.pack(none).count() == 0
    assert packing.pack(docs.coalesce(1)).select("sequence_id").distinct().count() == packing.pack(docs.coalesce(1)).where("offset = 0").count()


def filled(rows, most):
    """Sequences are without gaps, and full but for powers of two."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by.values():
        seq.sort()
        assert [o for o, _ in seq] == np.cumsum([0, *(n for _, n in seq)])[:-1].tolist()
        n = sum(k for _, k in seq)
        assert n <= most and (n == most or n & (n - 1) == 0)


def test_sequences_of_equal_partitions_have_numbers_of_their_own(docs):
    one = docs.coalesce(1)
    rows = packing.pack(one.union(one)).coalesce(1).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    filled(rows, 2048)


def test_packing_under_a_limit_on_loss(spark):
    """Instruction data: the last ids of a document bear loss."""
    docs = spark.createDataFrame([(i, prose(700 + i, 5 + i % 60), 3 + i % 40) for i in range(200)], "doc_id long, text string, answer int")
    rows = packing.pack(docs, limits=packing.Limits(256, 8, 60), loss_tail_col="answer").collect()
    by = {}
    for r in rows:
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], r["doc_tokens"] - min(r["doc_tokens"], 3 + r["doc_id"] % 40)))
        by.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["loss_tokens"] for r in seq) <= 60 and len(seq) <= 8 and sum(r["length"] for r in seq) <= 256 for seq in by.values())
    assert any(50 < sum(r["loss_tokens"] for r in seq) for seq in by.values())


def test_mixing(docs, none, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in got)
    sizes = {}
    for i, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    level = {s: 2 * n for s, n in sizes.items()}
    weights = dict(zip(sorted(k for k in sizes if k is not None) + [None], [5, 2, 1, 5, 2]))
    open_, left = set(sizes), 1.5 * sum(sizes.values())
    while open_:
        per = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= per * weights[s]}
        if not full:
            level |= {s: per * weights[s] for s in open_}
            break
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    target = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert target == {(sizes[s], round(level[s], 6)) for s in sizes}
    assert mixing.mix(none).count() == 0
    many = spark.createDataFrame([(i, "w " * (1 + i % 37), f"s{i % 4}") for i in range(3000)], "doc_id long, text string, source string")
    first = mixing.mix(many)
    per = first.withColumn("taken", F.col("copies") * F.col("size")).groupBy("source_size", "target").agg(F.sum("taken").alias("k")).collect()
    assert all(abs(r["k"] - r["target"]) <= 40 for r in per)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, mixing.mix(many.repartition(5)).collect()))
    kept = mixing.mix(docs, with_docs=True)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == len(ROWS)


def test_mixing_draws_some_of_repeated_rows(spark):
    """The target falls into 1,000 equal rows: as many of them are drawn as it asks for."""
    docs = spark.createDataFrame([(1, "w " * 20, "a")] * 1000 + [(i, "w " * 30, "b") for i in range(5000)], "doc_id long, text string, source string").repartition(5)
    for with_docs in (False, True):
        got = mixing.mix(docs, weights=(1, 20), share=1.0, with_docs=with_docs)
        size, target, copies = got.columns[-4 if with_docs else -4], got.columns[-2], got.columns[-1]
        per = got.groupBy(target).agg(F.sum(F.col(copies) * F.col("_size" if with_docs else "size")).alias("taken"), F.max(copies).alias("most"), F.min(copies).alias("least")).collect()
        assert len(per) == 2 and all(abs(r["taken"] - r[target]) <= 30 for r in per)
        assert any(r["least"] < r["most"] for r in per)


def test_documents_that_are_certain_leave_the_others_a_smaller_rest(spark):
    """Inclusion probabilities add up to the target's words though some would be above one."""
    sizes = spark.createDataFrame([("s", 10_000, 3), ("s", 100, 50), ("s", 4, 1000)], "_source string, _size long, _n long")
    per = spark.createDataFrame([("s", 39_000, 33_000.0, 33_000.0)], "_source string, source_size long, target double, _rest double")
    rate = mixing.rates(sizes, per, 1).first()["_rate"]
    words = [(10_000, 3), (100, 50), (4, 1000)]
    p = [min(1.0, rate * np.floor(np.sqrt(s) * 1000)) for s, _ in words]
    assert p[0] == 1.0 and p[2] < 1 and sum(s * n * q for (s, n), q in zip(words, p)) == pytest.approx(33_000, rel=1e-9)


def test_mixing_with_many_sources(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 50}") for i in range(500)], "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.mix(rows).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 1)
    assert sorted(map(tuple, mixing.mix(rows).collect())) == one


def test_pareto_sampling_has_its_probabilities(spark):
    """Inclusion frequencies follow the probabilities, which grow with the root of the size."""
    rows = [(i, "w " * (4 if i % 2 else 36), "s") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.3).collect()
    small = np.mean([r["copies"] for r in got if r["size"] == 4])
    large = np.mean([r["copies"] for r in got if r["size"] == 36])
    assert 2.4 < large / small < 3.6


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, "x"), (2, 0, "user", "<|im_end|>"), (2, 1, "assistant", "<\\|im_start|>\n<"), (3, 5, "assistant", "")]
    turns = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_from int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 2, 3: 1}
    assert got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256("user\n<|im_end|>\nassistant\n<\\|im_start|>\n<\n".encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256("<\\|im_start|>\n<".encode()).hexdigest()
    assert got[3]["loss_chars"] == 0
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_media(docs, none):
    got = media.from_media(media.to_media(docs)).collect()
    assert len(got) == len(ROWS)
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    for i, t, _ in ROWS:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        r = by[(i, len(b))]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert media.from_media(media.to_media(none)).count() == 0


def test_fingerprints(docs, none, spark):
    got = spotsigs.fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    key = lambda x: (-1 if x[0] is None else x[0], x[1] or "")
    order = sorted(ROWS, key=key, reverse=True)
    want = []
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((i, len(t), t[: len(t) - h] + nxt[:h]))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in got), key=repr) == sorted(want, key=repr)
    assert spotsigs.fingerprints(none).count() == 0
    one = spotsigs.fingerprints(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0 and len(one["fingerprint"]) % 8 == 0


def test_signatures_by_hand(spark):
    text = "The cat, of the big house: is RED. the"
    df = spark.createDataFrame([(text,), ("nothing here",), ("",)], "t string")
    got = [r[0] for r in df.select(F.size(spotsigs.signatures(F.col("t")))).collect()]
    # the:cat:big, of:big:house, the:big:house; `is` and the last `the` lack words. Without signatures, words.
    assert got == [3, 2, 0]


def test_spotsigs_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    lines = []
    for k in range(10):
        base = [("the " if rng.random() < 0.4 else "") + "w" + str(rng.integers(0, 400)) for _ in range(80)]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, 80)] = "zz" + str(rng.integers(0, 50))
            lines.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = {r["class_id"]: set(r["sigs"]) for r in spotsigs.classes(docs).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert want and {(r["a"], r["b"]) for r in spotsigs.near_duplicates(docs).collect()} == want


def test_toxicity(spark, none):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(800):
        words = prose(1000 + i % 90, 60).split()
        bad = i % 6 == 0
        if bad:
            for w in ("awfulword", "nastyterm", "vilething"):
                words[rng.integers(0, 60)] = w
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([got[i]["predicted"] == int(i % 6 == 0) for i in held]) > 0.95
    assert got[9000]["score"] == got[9001]["score"] and 0 <= got[9000]["score"] <= 1
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, known.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    wrong = known.withColumn("toxic", F.when(toxicity.remainder("doc_id") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, wrong)).collect()} == {i: r["score"] for i, r in got.items()}


def test_language_model(docs, none):
    got = mixture.score(docs).collect()
    assert len(got) == len(ROWS)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [w for w in (t or "").translate(low).replace("\n", " ").replace("\t", " ").split(" ") if w] + ["\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = {}
    for i, t, _ in ROWS:
        if not held(i):
            for w in words(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((repr(i), len(words(t)), sum(w in count for w in words(t)), round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words(t)), 4), held(i)) for i, t, _ in ROWS)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4), r["held_out"]) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)
    assert mixture.score(none).count() == 0


def test_language_model_keeps_repeated_rows(spark):
    """Partitions of equal rows, and of rows without ids whose first texts are equal."""
    rows = [(1, "one two"), (2, "three")] * 2 + [(None, "one two"), (None, "four"), (None, "one two"), (None, "five six seven")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    got = mixture.score(docs).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted([(1, 3), (2, 2)] * 2 + [(None, 3), (None, 2), (None, 3), (None, 4)], key=repr)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_language_model_scores_copies_apart(spark):
    """Held-out and training texts alike, if training texts have another copy; an order of words that no other text has is no copy."""
    rng = np.random.default_rng(11)
    known = prose(40, 60).split()
    texts = [" ".join(rng.choice(known, 40)) for _ in range(120)]
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in mixture.score(docs).collect()}
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    copies = [got[i] for i in [*range(20), *range(120, 140)] if learned((i + 120) % 240)]
    assert len(copies) > 25 and min(copies) > max(got[i] for i in range(20, 120))
    twice = mixture.score(docs.union(docs)).collect()
    assert len(twice) == 280


def test_language_model_against_plain_counts(spark, monkeypatch):
    """Scores by dictionaries of contexts, from the fitted codes, weights and refining table."""
    rng = np.random.default_rng(12)
    known = [*prose(41, 80).split(), "the", "of"]
    share = rng.dirichlet(np.full(len(known), 0.3))
    texts = [" ".join(rng.choice(known, rng.integers(0, 60), p=share)) + f" own{i}" for i in range(90)]
    texts += [*texts[:6], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    seen, scores = {}, mixture._scores

    def spy(coded, told, rules, sent, mixer):
        seen.update(rows=coded.collect(), rules=rules, mixer=mixer, blocks=seen["blocks"].collect())
        return scores(coded, told, rules, sent, mixer)

    monkeypatch.setattr(mixture, "_scores", spy)
    blocks = mixture._blocks
    monkeypatch.setattr(mixture, "_blocks", lambda rows: seen.setdefault("blocks", blocks(rows)))
    got = {r["doc_id"]: r["score"] for r in mixture.score(docs).collect()}
    import zstandard

    code, price, count = {}, {}, {}
    for b in seen["blocks"]:
        words = zstandard.ZstdDecompressor().decompress(b["words"]).decode().split(" ")
        mine = mixture.Words([r.asDict() for r in seen["rows"] if r["block"] == b["block"] and r["kind"] == 1])
        code |= dict(zip(words, mine.code.tolist()))
        price |= dict(zip(words, mine.price.tolist()))
        count |= dict(zip(words, mine.c.tolist()))
    rules, mixer, top = seen["rules"], seen["mixer"], mixture.CLASS + mixture.INDEX
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens_of = [[*(t or "").split(), "\n"] for t in texts]
    assert rules.n == sum(len(tokens_of[i]) for i in learned)
    kind = lambda w: code[w] >> mixture.INDEX
    common = lambda w: w is None or count[w] * mixture.COMMON >= rules.n
    target = lambda w: 0 if kind(w) == mixture.OTHER else code[w]
    bits_of = lambda w: mixture.CLASS + int(rules.bits[kind(w)])

    def contexts(words):
        out, frequent = [], [None, None]
        for k in range(len(words)):
            one, two = (words[k - 1] if k else None), (words[k - 2] if k > 1 else None)
            before = one if one is None or (count[one] * mixture.OFTEN >= rules.n and count[one] > 1) else ("class", kind(one))
            out.append([("none",), ("one", before), ("two", *frequent), None if common(one) and common(two) else ("pair", two, one)])
            if common(words[k]):
                frequent = [frequent[1], words[k]]
        return out

    n = {}
    for i in learned:
        for w, ctx in zip(tokens_of[i], contexts(tokens_of[i])):
            for k, c in enumerate(ctx):
                depth = top if k == 3 else min(mixture.DENSE_DEPTH[k], bits_of(w))
                for j in range(depth + 1 if c else 0):
                    n[c, j, target(w) >> (top - j)] = n.get((c, j, target(w) >> (top - j)), 0) + 1
    off = []  # tables hold 16 bits of a probability, which now and then moves a bit to the next step of the refining table
    for i, words in enumerate(tokens_of):
        own, told, total = int(i in learned), [], 0.0
        for k, (w, ctx) in enumerate(zip(words, contexts(words))):
            run = 0
            for back in (1, 2, 3):
                if k < back or not told[k - back]:
                    break
                run += 1
            told.append(n.get((ctx[3], top, target(w)), 0) > own if ctx[3] else bool(told) and told[-1])
            inputs, gates = [], []
            for j in range(bits_of(w)):
                x, level = [], 0
                for which, c in enumerate(ctx):
                    if c is None or which < 3 and j >= mixture.DENSE_DEPTH[which]:
                        x.append(0.0)
                        continue
                    whole = max(n.get((c, j, target(w) >> (top - j)), 0) - own, 0)
                    if which < 3:  # at its depth a context counts what comes by that bit alone
                        same = n.get((c, j + 1, target(w) >> (top - j - 1)), 0)
                    else:
                        same = n.get((c, j + 1, target(w) >> (top - j - 1)), 0)
                        level = int(np.searchsorted([1, 2, 4, 16], whole, "right"))
                    same = min(max(same - own, 0), whole)
                    x.append(np.log((same + 0.4) / (whole - same + 0.4)))
                inputs.append(x)
                gates.append((run * 5 + level) * 2 + (j >= mixture.CLASS))
            total += mixer.log10([np.array(x, np.float32) for x in zip(*inputs)], np.array(gates)).sum() + price[w]
        off.append(abs(got[i] - total))
    assert max(off) < 0.5 and np.mean(off) < 0.1


def test_language_model_keeps_nothing_beside_its_shuffles(spark, docs):
    """What is dealt to tasks is on the executors' disks once: as the shuffle's files, from which all uses read."""
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet().toArray())
    before = kept()
    assert mixture.score(docs).count() == len(ROWS)
    assert kept() <= before


def test_dealt_rows_are_not_dealt_again(spark):
    from twintongue.llm.common import dealt

    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    rows = dealt(spark.range(200).selectExpr("id", "id % 7 AS k").mapInArrow(count, "id long, k long").repartition(5, "k").sortWithinPartitions("k", "id"))
    one, two = rows.groupBy("k").count(), rows.groupBy("k").agg(F.sum("id").alias("s"))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, one.collect())) == [(k, len(range(k, 200, 7))) for k in range(7)]
    assert sorted(map(tuple, two.collect())) == [(k, sum(range(k, 200, 7))) for k in range(7)]
    assert met.value == 200
