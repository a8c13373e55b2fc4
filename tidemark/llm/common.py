"""Helpers shared by the training-data operators: scratch tables, blob frames, bit tools."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Whitespace of the text contracts: space and \t \n \v \f \r.
SPACES = "[\\x20\\x09-\\x0D]+"
LOWER_AZ = {i: i + 32 for i in range(65, 91)}
MASK64 = (1 << 64) - 1


def _hadoop(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends at the latest."""
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    hpath, fs = _hadoop(spark, path)
    fs.deleteOnExit(hpath)
    return path


#: Whole texts cross to Python in batches of so many rows, where the caller left Spark's default.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch: texts are long, and Spark's default is ten thousand of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, and the optimizer sees real sizes.
    Shuffle files of the write go when it is over. `forget` deletes the table.
    """
    spark = df.sparkSession
    modest_batches(spark)
    path = scratch_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for t in tables:
        hpath, fs = _hadoop(t.sparkSession, t._scratch)
        fs.delete(hpath, True)


def whole_text(name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id written as text; null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def take(docs: DataFrame, **named: Column) -> DataFrame:
    """Only the named columns, so that extra columns of the input can never clash."""
    return docs.select(*[c.alias(k) for k, c in named.items()])


def packed(docs: DataFrame, keep: list[str] | None, *results: str) -> Column:
    """The columns to hand through as one struct, `__row`, so that no name of theirs can clash.

    Columns named like an operator's `results` give way to them.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in names], *([] if names else [F.lit(0).alias("__none")])).alias("__row")


def unpacked(df: DataFrame, *results: str) -> DataFrame:
    """The columns of `__row`, then the results."""
    names = [c for c in df.schema["__row"].dataType.names if c != "__none"]
    return df.select(*[F.col("__row").getField(c).alias(c) for c in names], *results)


_STATE: dict = {}


def worker_state(key, make):
    """What a worker process remembers between tasks: one thing, so that a later operator's memory takes the place of an earlier one's."""
    if key not in _STATE:
        forget_state()
        _STATE[key] = make()
    return _STATE[key]


def release_memory() -> None:
    """Give freed memory back to the system: it stays with the allocators of a worker otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget_state() -> None:
    """Give back what an earlier operator left in this worker; for steps that need no memory of their own."""
    if _STATE:
        _STATE.clear()
        gc.collect()
        release_memory()


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & MASK64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def window_codes(seq: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for each run of `size` numbers."""
    n = len(seq) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            code = code * np.uint64(0x9E3779B97F4A7C15) + mix64(seq[i : i + n], i)
    return code


def ragged_take(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Concatenate values[starts[r] : starts[r] + lengths[r]] for each r of rows."""
    n = lengths[rows]
    total = int(n.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return values[shift + np.arange(total)]
