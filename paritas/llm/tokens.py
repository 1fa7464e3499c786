"""Token counts of flat token files: a vectorised scan for end-of-document identifiers.

``write_token_files`` makes such files from documents: a file is a run of little-endian 16-bit ids in
which ``EOD`` ends each document, cut into blocks of a fixed number of ids that know nothing of
document boundaries. ``count_tokens`` reads blocks of any origin (see ``read_flat_files`` for files
on a file system): within a block it finds separators with one numpy comparison; a window over a
file's blocks is the prefix scan that says how many documents and ids come before a block, so that a
document that spans blocks is stitched together. Only block summaries are shuffled, by file.

Files are bounded by the input split that made them, so no window is unbounded. Defined cases: a null
or empty text is a document without ids (count 0); ids after the last separator are a document
without an end, reported with ``ended`` false; a file without ids has no rows; equal files and
repeated rows are counted apart; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.llm.shared import by_value, written

BLOCK, EOD = 1 << 16, 50256
_KIND = "<u2"


def write_token_files(docs: DataFrame, path: str, pattern: str | None = None, block: int = BLOCK) -> DataFrame:
    """Encode ``docs`` into flat files: rows (file_id, block_no, ids binary, ending array of doc_id).

    ``ending`` lists the documents whose last id lies in the block. It is kept beside the flat data to
    name results; the scan does not read it.
    """
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    sent, pattern = docs.sparkSession.sparkContext.broadcast(ranks), pattern or public_tokenizers.PATTERN

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        enc = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        file_id, no, kept, ending, have = TaskContext.get().partitionId(), 0, [], [], 0

        def flat() -> pa.RecordBatch:
            columns = [pa.array([file_id], pa.int64()), pa.array([no], pa.int64()), pa.array([np.concatenate(kept).tobytes()], pa.binary()), pa.array([ending], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["file_id", "block_no", "ids", "ending"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*(enc.encode_ordinary(t) if t else ()), EOD], dtype=_KIND)
                while have + len(ids) > block:
                    kept.append(ids[: block - have])
                    ids = ids[block - have :]
                    yield flat()
                    no, kept, ending, have = no + 1, [], [], 0
                kept.append(ids)
                ending.append(i)
                have += len(ids)
        if have:
            yield flat()

    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "file_id long, block_no long, ids binary, ending array<long>")
    return written(blocks, "tokens")


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks (file_id, block_no, ids) of real flat files, through Spark's reader of binary files."""
    size = 2 * block
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select(F.xxhash64("path").alias("file_id"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block_no")).select(
        "file_id", "block_no", F.substring("content", (F.col("block_no") * size + 1).cast("int"), F.lit(size)).alias("ids")
    )


def count_tokens(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file_id, ordinal, block_no, start, n_tokens, ended): one row per document of each file."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, b, raw in zip(batch["file_id"], batch["block_no"], batch["ids"], strict=True):
                x = np.frombuffer(raw, dtype=_KIND)
                rows.append((f, b, len(x), np.flatnonzero(x == eod)))
            yield pd.DataFrame({"file_id": [r[0] for r in rows], "block_no": [r[1] for r in rows], "n": [r[2] for r in rows], "ends": [r[3] for r in rows]})

    found = blocks.select("file_id", "block_no", "ids").mapInPandas(scan, "file_id long, block_no long, n long, ends array<long>")
    order = Window.partitionBy("file_id").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("ends")
    found = found.withColumns(
        {
            "docs_before": F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)),
            "ids_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "next_block": F.lead("block_no").over(order),
        }
    )
    # place of the last separator in earlier blocks, from the start of the file
    last = F.when(size > 0, F.col("ids_before") + F.element_at("ends", -1))
    found = found.withColumn("carry", F.coalesce(F.max(last).over(before), F.lit(-1)))
    ended = F.transform("ends", lambda e, i: F.struct(e.alias("e"), i.cast("long").alias("i"), F.lit(True).alias("ended")))
    tail = F.when(
        F.col("next_block").isNull() & (F.coalesce(last, F.col("carry")) < F.col("ids_before") + F.col("n") - 1),
        F.array(F.struct(F.col("n").alias("e"), size.cast("long").alias("i"), F.lit(False).alias("ended"))),
    ).otherwise(F.array().cast("array<struct<e: bigint, i: bigint, ended: boolean>>"))
    previous = F.when(F.col("d.i") > 0, F.col("ids_before") + F.get("ends", (F.col("d.i") - 1).cast("int"))).otherwise(F.col("carry"))
    docs = found.withColumn("d", F.explode(F.concat(ended, tail)))
    return docs.select(
        "file_id",
        (F.col("docs_before") + F.col("d.i")).alias("ordinal"),
        "block_no",
        F.col("d.i").alias("in_block"),
        (previous + 1).alias("start"),
        (F.col("ids_before") + F.col("d.e") - previous - 1).alias("n_tokens"),
        F.col("d.ended").alias("ended"),
    )


def token_report(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Write ``docs`` as flat files, scan them, and name each document's count."""
    blocks = write_token_files(docs, path, pattern)
    names = blocks.select("file_id", "block_no", F.posexplode("ending").alias("in_block", "doc_id"))
    counts = count_tokens(blocks).withColumn("in_block", F.col("in_block").cast("int"))
    return counts.join(names, ["file_id", "block_no", "in_block"]).select("doc_id", "file_id", "ordinal", "start", "n_tokens")


by_value(__name__)
