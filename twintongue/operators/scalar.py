"""Scalar functions of the dialect, and files, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as D
from ..plans.fixpoint import shared_dir
from ..sources import files
from .base import engine_on


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return engine_on(spark, sf_dir, name).table(name)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def fn_concat(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", D.concat(F.col("c_name"), F.lit("-"), F.nullif(F.col("c_nationkey"), F.lit(3)), F.col("c_nationkey") > 5).alias("v"))


def fn_substr(spark, sf_dir):
    c = _table(spark, sf_dir, "part")
    return c.select("p_partkey", D.substr(F.col("p_name"), 3, 4).alias("a"), D.substr(F.col("p_name"), 0, 3).alias("b"), D.substr(F.col("p_name"), 5).alias("c"), D.substr(F.col("p_name"), -2, 3).alias("d"))


def fn_trim(spark, sf_dir):
    padded = F.concat(F.lit(" \t "), F.col("r_name"), F.lit("\n "))
    return _table(spark, sf_dir, "region").select("r_regionkey", D.trim(padded).alias("b"), D.trim(padded, right=False).alias("l"), D.trim(padded, left=False).alias("r"))


def arith_functions(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    zero = F.col("p_size") % 3
    return p.select("p_partkey", D.divide(F.col("p_size"), zero, True).alias("d"), D.modulo(F.col("p_size"), zero).alias("m"), F.round(D.divide(F.col("p_retailprice"), zero, False), 4).alias("f"))


def fn_json_extract(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", D.json_extract(F.col("props"), "$.k").alias("k"), D.json_extract(F.col("props"), "k").alias("k2"), D.json_extract(F.col("props"), "$.none").alias("missing"))


_ARRAYS = """SELECT event_id, concat('{"list":[', event_id % 5, ',', event_id % 3, ',{"x":', user_id, '}],"t":true,"n":null,"s":"a"}') AS j FROM events"""


def fn_json_array_length(spark, sf_dir):
    e = engine_on(spark, sf_dir, "events").sql(_ARRAYS)
    return e.select("event_id", D.json_array_length(F.col("j"), "$.list").cast("long").alias("n"), D.json_extract(F.col("j"), "$.list[2].x").alias("x"))


def fn_json_type(spark, sf_dir):
    e = engine_on(spark, sf_dir, "events").sql(_ARRAYS)
    return e.select("event_id", *[D.json_type(F.col("j"), p).alias(n) for n, p in (("o", None), ("a", "$.list"), ("num", "$.list[0]"), ("b", "$.t"), ("s", "$.s"))])


def fn_json_valid(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", D.json_valid(F.when(F.col("event_id") % 4 == 0, F.lit("{bad")).when(F.col("event_id") % 4 == 1, F.lit(None)).otherwise(F.col("props"))).alias("ok"))


def csv_write(spark, sf_dir):
    path = _scratch(spark)
    files.write_csv(_table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))), path)
    return files.read_csv(spark, path, schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


def csv_read(spark, sf_dir):
    path = _scratch(spark)
    files.write_csv(_table(spark, sf_dir, "nation"), path)
    return files.read_csv(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def json_write(spark, sf_dir):
    path = _scratch(spark)
    files.write_json(_table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal"))), path)
    return files.read_json(spark, path, lines=True).select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


def json_read(spark, sf_dir):
    path = _scratch(spark)
    rows = files.json_array(_table(spark, sf_dir, "region"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]")).alias("value")).write.text(path)
    return files.read_json(spark, path).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


def export_import(spark, sf_dir):
    engine, path = engine_on(spark, sf_dir, "nation"), _scratch(spark)
    files.export_table(engine, "nation", path, "json")
    engine.sql("CREATE TABLE copy (n_name TEXT, n_nationkey INT PRIMARY KEY, extra TEXT DEFAULT 'none')")
    files.import_table(engine, "copy", files.read_json(spark, path, lines=True))
    return engine.sql("SELECT n_nationkey, n_name, extra FROM copy")


FUNCTIONS = {f.__name__: f for f in (fn_concat, fn_substr, fn_trim, arith_functions, fn_json_extract, fn_json_array_length, fn_json_type, fn_json_valid, csv_write, csv_read, json_write, json_read)} | {"export_table": export_import, "import_table": export_import}

_DUCK_ARRAYS = _ARRAYS
SQL = {
    "fn_concat": "SELECT c_custkey, concat(c_name, '-', NULLIF(c_nationkey, 3), c_nationkey > 5) AS v FROM customer",
    "fn_substr": "SELECT p_partkey, substr(p_name, 3, 4) AS a, substr(p_name, 1, 3) AS b, substr(p_name, 5) AS c, '' AS d FROM part",
    "fn_trim": "SELECT r_regionkey, r_name AS b, r_name || chr(10) || ' ' AS l, ' ' || chr(9) || ' ' || r_name AS r FROM region",
    "arith_functions": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size // (p_size % 3) AS BIGINT) END AS d, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % (p_size % 3) END AS m, CASE WHEN p_size % 3 = 0 THEN NULL ELSE round(p_retailprice / (p_size % 3), 4) END AS f FROM part",
    "fn_json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS k2, json_extract_string(props, '$.none') AS missing FROM events",
    "fn_json_array_length": f"SELECT event_id, CAST(json_array_length(j, '$.list') AS BIGINT) AS n, json_extract_string(j, '$.list[2].x') AS x FROM ({_DUCK_ARRAYS})",
    "fn_json_type": "SELECT event_id, 'object' AS o, 'array' AS a, 'number' AS num, 'boolean' AS b, 'string' AS s FROM events",
    "fn_json_valid": "SELECT event_id, event_id % 4 > 1 AS ok FROM events",
    "csv_write": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer",
    "csv_read": "SELECT * FROM nation",
    "json_write": "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS s_acctbal FROM supplier",
    "json_read": "SELECT * FROM region",
    "export_table": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'none' AS extra FROM nation",
    "import_table": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'none' AS extra FROM nation",
}
