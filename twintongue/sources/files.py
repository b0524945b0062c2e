"""CSV and JSON as sources and sinks of an engine's tables.

All go through Spark's readers and writers, so that any file system Spark knows
will do. CSV: an empty cell is NULL, types are inferred. JSON: an array of objects,
whose columns are the first object's keys; nested values become NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import relation_of
from ..plans.engine import Done, Engine

_NESTED = (T.ArrayType, T.StructType, T.MapType)


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """With a schema nothing is read twice; without, types are inferred and columns without header are col0, col1, ..."""
    reader = spark.read.option("header", header).option("nullValue", "").option("emptyValue", "").option("preferDate", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df if header or schema else df.toDF(*[f"col{i}" for i in range(len(df.columns))])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """lines: an object a line, which can be read in parts; else one array of objects a file."""
    df = spark.read.option("multiLine", not lines).json(path)
    if not lines:
        # Inference sorts the columns by name; the file's first object has their order.
        text = spark.read.option("wholetext", True).text(path).select(F.get_json_object(F.col("value"), "$[0]").alias("first"))
        keys = text.select(F.json_object_keys("first").alias("k")).first()
        if keys and keys["k"]:
            df = df.select(*[F.col(f"`{k}`") for k in keys["k"] if k in df.columns])
    return df.select(*[F.lit(None).cast("string").alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """An object a line; NULL is written, NaN becomes NULL."""
    clean = [F.when(~F.isnan(f.name), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_array(df: DataFrame) -> DataFrame:
    """The rows as objects in one text column, `json`."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def import_table(engine: Engine, table: str, rows: DataFrame) -> Done:
    """Columns are matched by name; others are left out, missing ones get their default; triggers and constraints apply. A new table is made where none is."""
    if table.lower() not in engine.catalog.tables:
        engine.catalog.create(table, relation_of(rows))
        return Done("IMPORT", rows.count())
    return engine.insert_rows(table, rows)


def export_table(engine: Engine, table: str, path: str, kind: str = "csv") -> None:
    {"csv": write_csv, "json": write_json}[kind](engine.table(table), path)
