"""What the corpus operators share: the cluster's shared folder, written tables and word splitting."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word.
SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again (columns can then be pruned)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows per Arrow batch for the actions within: wide rows need small batches in Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has or begins with."""
    name = f"__{base}"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def may_hold(rows: DataFrame, column: str, need: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose hash ``column`` may be in ``need`` (one column of hashes), and those where it is not.

    A bitmap with 16 bits for each of the hashes, made by an aggregation, is broadcast; about 1 of 16
    rows with other hashes passes it too. If it would have more than ``most_bits``, all rows are joined instead.
    """
    bits, hashes = 1 << 16, need.count()
    while bits < 16 * hashes:
        bits *= 2
    mine, bucket, bit, found = (free_name(rows, x) for x in ("place", "bucket", "bit", "found"))
    if bits > most_bits:
        marked = rows.join(need.toDF(mine).distinct().withColumn(found, F.lit(1)), F.col(column) == F.col(mine), "left")
        return tuple(marked.filter(x).select(*[F.col(f"`{c}`") for c in rows.columns]) for x in (F.col(found).isNotNull(), F.col(found).isNull()))

    def place(hash_column: str) -> Column:
        return F.pmod(F.xxhash64(hash_column), F.lit(bits))

    ones = need.toDF(mine).select(place(mine).alias(mine))
    table = ones.groupBy(F.bitmap_bucket_number(mine).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mine)).alias(found))
    marked = rows.withColumn(mine, place(column)).withColumn(bit, F.bitmap_bit_position(mine))
    marked = marked.join(F.broadcast(checkpoint(table.withColumnRenamed(bucket, f"{bucket}t"))), F.bitmap_bucket_number(mine) == F.col(f"{bucket}t"), "left")
    byte = F.conv(F.hex(F.substring(found, (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return marked.filter(there).select(*columns), marked.filter(~there).select(*columns)


def give_back() -> None:
    """Return a task's freed memory to the machine: Python workers live on and share an executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_value(name: str) -> None:
    """Send this module's functions to Python workers by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def trimmed(text: Column) -> Column:
    """Text without leading and trailing ASCII white space; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))


def without_space(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACE_CHARS, "")


def split_words(trimmed_text: Column) -> Column:
    """Words of a trimmed text, as an array; an empty text has none."""
    return F.when(trimmed_text == "", F.array().cast("array<string>")).otherwise(F.split(trimmed_text, SPACE, -1))


def count_words(trimmed_text: Column) -> Column:
    return F.when(trimmed_text == "", F.lit(0)).otherwise(F.size(F.split(trimmed_text, SPACE, -1))).cast("long")


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


by_value(__name__)
