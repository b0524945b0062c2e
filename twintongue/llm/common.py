"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of at most about so many bytes are worked on at once in a Python worker.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder under the warehouse serves if all is one machine, as in tests.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return own.rstrip("/")


def few(df: DataFrame, each: int = 2) -> DataFrame:
    """df in fewer partitions, as many small files cost more than they help.

    At least `each` for each core, and one for 8 shuffle partitions: these are set
    by the size of the data, so that tasks don't grow with it.
    """
    spark = df.sparkSession
    return df.coalesce(max(each * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def written(df: DataFrame, label: str, each: int = 1) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here. each: see few; 2 where much is computed."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    few(df, each).write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()  # Spark deletes the shuffle files of a finished job when the driver has collected its plan
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column has it (names are alike in upper and lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(docs: DataFrame, but: str | None = None) -> Column:
    """All columns of docs (but one) as one column _doc, so that no name clashes with an operator's own."""
    return F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != but]).alias("_doc")


def together(docs: DataFrame, but: str | None = None, text: Column | None = None) -> list[Column]:
    """The columns of docs from _doc, and `text` in the place of the one that is not there."""
    return [(text if c == but else F.col(f"_doc.c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks; what is lost with an executor is computed again, so df must come out the same."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.DISK_ONLY)


def dealt(df: DataFrame) -> DataFrame:
    """df, whose last exchange is run at once and whose files serve all uses: nothing is kept beside them.

    What is lost with an executor is computed again, so df must come out the same. The files go
    when nothing refers to df any more. This is Dataset.checkpoint without the writing.
    """
    spark, ran = df.sparkSession, df._jdf.queryExecution()
    of = lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
    rdd, sql, plan = ran.toRdd(), spark._jvm.org.apache.spark.sql, ran.executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    none = getattr(sql.execution.LogicalRDD, "apply$default$6")()
    # How the rows are dealt out and sorted is told, so that joins by the same key don't deal them again.
    known = of(sql.execution, "LogicalRDD").apply(plan.output(), rdd, plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(of(sql.classic, "Dataset").ofRows(spark._jsparkSession, known), spark)


def give_back() -> None:
    """Returns a worker's free memory to the system, as workers live on from task to task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1, int64, from 0) of a string or binary array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts add up to about `most` bytes; a longer text is alone."""
    for b in batches:
        if not b.num_rows:
            continue
        _, o = string_buffers(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def col_of(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of lens[i] elements each, one after the other."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts.astype(np.int64) - before, lens) + np.arange(total)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
