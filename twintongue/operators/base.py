"""Engines over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine_on(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine with these tables of the folder (all named in a query, so that no other file is opened)."""
    engine = Engine(spark)
    for name in names:
        engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return engine


def sql_query(text: str):
    """A query function that runs SQL over the tables it names."""
    from ..plans.changes import words_of

    names = [t for t in TABLES if t in words_of(text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_on(spark, sf_dir, *names).sql(text)

    return run
