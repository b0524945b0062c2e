"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor,
which are written as Parquet and read again in between. All stages but the last
return the columns of documents.

Defined results: a null text is empty to every stage and stays null up to the last;
documents with equal texts, empty ones included, are copies of each other, of which
one stays; ties and repeated rows are as in each operator's module; a null doc_id
and a null source are kept; other columns, whatever their names, go through all
stages but the last; an empty table gives an empty table.

SQL cannot express the first stages (a fitted model, sketches), so ORACLE_SQL is
None; tests/llm/test_pipeline.py holds every stage against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintongue.llm import minhash, mixing, packing, suffix, toxicity
from twintongue.llm.common import few, fresh, table, written

ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not predict to be toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return few(scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return few(minhash.keep_one(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes covered by a repeated string of 200 bytes; characters that lose a byte go whole."""
    cut = suffix.dedup(docs, as_text=True)
    stays = F.col(cut.columns[len(docs.columns)])
    changed = {"text": F.when(F.col("text").isNotNull(), stays), "n_chars": F.when(F.col("text").isNotNull(), F.char_length(stays).cast(docs.schema["n_chars"].dataType))}
    return few(cut.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns]))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as the mix takes it."""
    mixed = mixing.mix(docs, with_docs=True)
    copies = F.col(mixed.columns[-1])
    return mixed.where(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(fresh("_copy", docs.columns))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("mixing_sources", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", 2)
    return STAGES[-1][1](spark, docs, sf_dir)
