"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Each shard owns ``vnodes`` virtual nodes at hashed cells; a row hashes
to a cell by its id and the CRC of its text and belongs to the next virtual node clockwise. A shard
takes rows up to its bound, which is the row count divided by the shards, rounded down or up; rows of
an arc beyond the bound continue clockwise to the next shard with room. So counts are at most one
apart (law ``rows``), while a row only moves when its own shard is full.

Only counts by arc (shards x vnodes, whatever the corpus) reach the driver, which lays out the
overflow as ranges of ranks. Ranks come from counts by cell and a window within each cell, so no
window holds more than a cell. Texts are never shuffled. Broadcast tables are bounded by the ring:
``CELLS`` rows, and arcs plus one piece for each time a shard fills up or an arc overflows.

Defined cases: a null text has size 16 and CRC 0; a null id hashes by the text alone; repeated rows
get slots of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.shared import checkpoint

CELLS = 1 << 16


def _ring(spark, shards: int, vnodes: int) -> DataFrame:
    """(cell, arc, shard): the virtual node at or after each cell; the lowest shard wins a shared cell."""
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("long").alias("v"))
        .select(F.pmod(F.xxhash64(F.lit("ring"), "shard", "v"), F.lit(CELLS)).alias("cell"), "shard")
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))
        .withColumn("node", F.struct(F.col("cell").alias("arc"), "shard"))
    )
    # frames that only grow: linear in the cells
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = spark.range(CELLS).select(F.col("id").alias("cell")).join(nodes.select("cell", "node"), "cell", "left")
    return cells.select("cell", F.coalesce(F.last("node", True).over(ahead), F.first("node", True).over(whole)).alias("node")).select("cell", "node.*")


def overflow_plan(arcs: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, from_rank, to_rank, shard, first_slot) for arcs (arc, shard, rows) in ring order."""
    total = sum(n for _, _, n in arcs)
    load = [0] * shards
    for _, s, n in arcs:
        load[s] += n
    room = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-load[s], s))[: total % shards]:
        room[s] += 1
    slot, pieces, late = [0] * shards, [], []

    def put(arc: int, start: int, rows: int, s: int) -> int:
        if take := min(rows, room[s]):
            pieces.append((arc, start, start + take, s, slot[s]))
            room[s] -= take
            slot[s] += take
        return take

    for i, (arc, s, n) in enumerate(arcs):
        if (took := put(arc, 0, n, s)) < n:
            late.append((i, arc, took, n))
    for i, arc, start, n in late:
        j = i
        while start < n:
            j = (j + 1) % len(arcs) if arcs else 0
            if j == i and not any(room[s] for _, s, _ in arcs):  # a shard without a virtual node of its own
                for s in range(shards):
                    start += put(arc, start, n - start, s)
                break
            start += put(arc, start, n - start, arcs[j][1])
    return pieces


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """One row per document with its shard and its slot in it."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("h", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 48))
    ring = _ring(spark, shards, vnodes)
    counts = rows.groupBy("cell").agg(F.count("*").alias("n")).join(F.broadcast(ring), "cell")
    before = Window.partitionBy("arc").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    # an arc may run past the last cell to the first: cells after its node come first in its order
    order = F.when(F.col("cell") > F.col("arc"), F.col("cell") - CELLS).otherwise(F.col("cell"))
    cells = checkpoint(counts.withColumn("order", order).select("cell", "arc", "shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    arcs = sorted((r[0], r[1], r[2]) for r in cells.groupBy("arc", "shard").agg(F.sum("n").alias("n")).collect())
    pieces = overflow_plan(arcs, shards)
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([dict(zip(("arc", "lo", "hi", "shard", "slot0"), p, strict=True)) for p in pieces])), "array<struct<arc: bigint, lo: bigint, hi: bigint, shard: int, slot0: bigint>>")).alias("p")).select("p.*")
    inside = Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rn", F.row_number().over(inside) - 1).join(F.broadcast(cells.select("cell", "arc", "base")), "cell")
    ranked = ranked.withColumn("rank", F.col("base") + F.col("rn"))
    placed = ranked.join(F.broadcast(plan), (ranked.arc == plan.arc) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
