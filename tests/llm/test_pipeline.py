"""The pipeline on the small documents, every stage against a plain version of it."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from twintongue.llm import minhash, tokens, toxicity
from twintongue.llm.common import table, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def outputs(spark):
    docs = table(spark, SF, "documents")
    out = [docs.toPandas().sort_values("doc_id")]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.toPandas())
    return out


def test_stages_keep_the_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "mixing_sources", "packing"]
    assert all(list(o.columns) == list(outputs[0].columns) for o in outputs[:-1])


def test_toxic_documents_go(spark, outputs):
    docs = table(spark, SF, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"))).toPandas()
    assert set(outputs[1].doc_id) == set(scored.doc_id[scored.score < 0.3])


def test_one_of_each_group_stays(outputs):
    texts = outputs[1].sort_values("doc_id")
    n, text, h = len(texts), *minhash.shingles(pa.array(texts.text))[:2]
    sets = [h[text == i] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if texts.text.iloc[i] == texts.text.iloc[j] or minhash.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(outputs[2].doc_id) == {texts.doc_id.iloc[i] for i in range(n) if find(i) == i}


def test_repeated_strings_go(outputs):
    before, after = outputs[2], outputs[3].set_index("doc_id")
    seen = {}
    for t in before.text:
        b = t.encode()
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for d, t in zip(before.doc_id, before.text):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if b else ""
        assert after.text[d] == kept and after.n_chars[d] == len(kept)


def test_mix_repeats_whole_documents(outputs):
    before, after = outputs[3].set_index("doc_id"), outputs[4]
    assert after.doc_id.value_counts().max() <= 2
    for d, t in zip(after.doc_id, after.text):
        assert before.text[d] == t
    words = before.text.str.split().str.len()
    total = after.text.str.split().str.len().sum()
    assert abs(total - 1.5 * words.sum()) <= 0.1 * words.sum()


def test_packs_hold_all_ids(outputs):
    enc = tokens.shared_encoder(tokens.tokenizer_path())
    docs, pieces = outputs[4], outputs[5]
    want = sum(len(enc.tok.encode(t, add_special_tokens=False).ids) + 1 for t in docs.text)
    assert pieces.length.sum() == want and pieces.groupby("sequence_id").length.sum().max() <= 2048
    for d, t in docs.drop_duplicates("doc_id").head(40)[["doc_id", "text"]].values:
        ids = [*enc.tok.encode(t, add_special_tokens=False).ids, 1]
        mine = pieces[pieces.doc_id == d]
        assert len(mine) and all(np.frombuffer(i, "<u4").tolist() == ids[s : s + n] for i, s, n in zip(mine.ids, mine.start, mine.length))


def test_hard_rows_go_through_all_stages(spark):
    """Nulls in any column, empty texts, repeated rows, ties, names that the operators use themselves, and an empty table."""
    docs = table(spark, SF, "documents")
    own = ["score", "predicted", "_key", "_id", "_node", "_size", "_source", "_copies", "_copy", "_doc", "_kept", "_z", "class_id", "Text_"]
    more = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "a few words of no id", "en", None, None), (9003, "twice the same row", None, "src1", 18), (9003, "twice the same row", None, "src1", 18)], docs.schema)
    rows = docs.unionByName(more).select("*", *[(F.lit(c) if i % 2 else F.lit(None).cast("int")).alias(c) for i, c in enumerate(own)])
    now = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, SF), f"test-hard-{name}")
        assert now.columns == rows.columns and now.schema.simpleString() == rows.schema.simpleString()
        assert now.where("score is not null or predicted <> 'predicted' or _node is not null or _id <> '_id' or Text_ <> 'Text_'").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    ids = {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()}
    assert ids == {r["doc_id"] for r in now.select("doc_id").distinct().collect()} and None in {r["doc_id"] for r in rows.select("doc_id").collect()}
    none = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
