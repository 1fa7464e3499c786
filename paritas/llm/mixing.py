"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size gives each of its rows the same number of copies p. The whole part
of p is taken; the fractional part is rounded by pivotal steps. Equal rows of a source are one unit: of m
rows with a fraction f each, floor(m * f) take one more copy, and one row with what is left of m * f takes part
in the steps, so a unit of any number of rows counts as one document there: two fractional units meet, mass moves between them until one of them is integral, in
such a way that size times copies stays the same and every unit keeps its expectation; the other one
meets the next unit. Units meet within hashed buckets of bounded size; each bucket leaves one residual
unit, and residuals meet in a reduction tree until a source has one, which is rounded by itself. So a
source's taken words differ from its target by less than the size of its last unit.

Order and draws come from hashes of the rows, not from partitions: reruns agree. Only slim rows
without texts are shuffled; a hot source spreads over its buckets. Per-source statistics are broadcast
only if a count shows that there are at most ``BROADCAST`` sources.

Defined cases: null or empty texts have size 0 and are never taken; very long texts are units like others;
null sources form one source, the last; null ids are rows like others; ties of hashes go by id and size; an empty table gives an empty table; other columns are ignored
here and carried by ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.shared import by_value, checkpoint, count_words, free_name, trimmed, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BUCKET, FAN_IN, BROADCAST = 4096, 1024, 10_000
_UNIT = "blank boolean, id long, h long, source string, rank int, source_size long, target double, m long, size long, whole int, more long, f double, bucket long"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, rank, source_size, units, target) from rows (source, size).

    Targets are min(most * size, level * weight) with the one level that makes them add up to all
    sizes: the fixed point of resharing each excess by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    ranked = ranked.withColumn("l", level)
    # the first source, in that order, which its own level does not fill
    first = F.when(F.col("l") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "l"))
    ranked = ranked.withColumn("level", F.min(first).over(whole)["l"])
    return ranked.select("source", "rank", "source_size", "units", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"), F.lit(0.0)).alias("target"))


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def pivotal(size: Sequence[float], f: Sequence[float], u: Sequence[float]) -> tuple[list[float], int]:
    """Round fractions f in order; returns them with at most one left fractional, and its place (or -1)."""
    f, held = list(f), -1
    for i in range(len(f)):
        if not 0.0 < f[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min(size[a] * (1 - f[a]), size[b] * f[b])  # words that a can gain from b
        down = min(size[a] * f[a], size[b] * (1 - f[b]))  # and lose to b
        if u[i] * (up + down) < down:
            a_full = size[a] * (1 - f[a]) <= size[b] * f[b]
            fa, fb = (1.0, f[b] - up / size[b]) if a_full else (f[a] + up / size[a], 0.0)
        else:
            a_empty = size[a] * f[a] <= size[b] * (1 - f[b])
            fa, fb = (0.0, f[b] + down / size[b]) if a_empty else (f[a] - down / size[a], 1.0)
        f[a], f[b] = min(max(fa, 0.0), 1.0), min(max(fb, 0.0), 1.0)
        held = a if 0.0 < f[a] < 1.0 else b if 0.0 < f[b] < 1.0 else -1
    return f, held


def _round_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "blank", "id", "size"], kind="stable").reset_index(drop=True)
    f, _ = pivotal(rows["size"].astype(float).tolist(), rows["f"].tolist(), _uniform(rows["h"].to_numpy(np.int64).view(np.uint64)).tolist())
    return rows.assign(f=f)


def _row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def mix_units(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Units (doc_id, h, source, m equal rows, size of one, whole, more): each row is taken ``whole`` times and ``more`` of them once more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("h"), "source", count_words(trimmed(text)).alias("size"))
    units = checkpoint(rows.groupBy("doc_id", "h", "source").agg(F.count("*").alias("m"), F.first("size").alias("size")))
    stats = checkpoint(source_targets(units.select("source", (F.col("m") * F.col("size")).alias("size")), weights, most))
    side = F.broadcast(stats) if stats.count() <= BROADCAST else stats
    units = units.join(side.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("p", F.least(p, F.lit(float(most)))).withColumn("whole", F.floor("p").cast("int"))
    buckets = F.ceil(F.col("units") / F.lit(float(BUCKET)))
    f = F.when(F.col("size") > 0, F.col("m") * (F.col("p") - F.col("whole"))).otherwise(0.0)
    units = units.withColumn("more", F.floor(f).cast("long")).withColumn("f", f - F.col("more")).withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(1)), buckets).cast("long"))
    # an id that may be null would become a float in pandas
    own = [F.col("doc_id").isNull().alias("blank"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")]
    units = units.select(*own, "h", "source", "rank", "source_size", "target", "m", "size", "whole", "more", "f", "bucket")
    most_buckets = stats.agg(F.max(F.ceil(F.col("units") / F.lit(float(BUCKET))))).first()[0] or 1

    done, level = [], units
    while True:
        level = checkpoint(level.groupBy("rank", "bucket").applyInPandas(_round_bucket, _UNIT))
        left = (F.col("f") > 0) & (F.col("f") < 1)
        if most_buckets <= 1:
            draw = F.pmod(F.xxhash64("h", F.lit("last")), F.lit(1 << 53)) / F.lit(float(1 << 53))
            done.append(level.withColumn("f", F.when(left, (draw < F.col("f")).cast("double")).otherwise(F.col("f"))))
            break
        done.append(level.filter(~left))
        level = level.filter(left).withColumn("bucket", (F.col("bucket") / FAN_IN).cast("long"))
        most_buckets = -(-most_buckets // FAN_IN)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    some = F.col("size") > 0
    return out.select(
        F.when(~F.col("blank"), F.col("id")).alias("doc_id"), "h", "source", "source_size", "target", "m", "size",
        F.when(some, F.col("whole")).otherwise(0).alias("whole"), F.when(some, F.col("more") + F.round("f").cast("long")).otherwise(F.lit(0).cast("long")).alias("more"),
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document with the words that the mix takes of it."""
    units = mix_units(docs)
    # a unit of very many rows is dealt out in parts before it is unfolded
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / BUCKET)))
    many = units.filter(F.col("m") > BUCKET).withColumn("part", part).repartition("h", "part")
    parts = units.filter(F.col("m") <= BUCKET).withColumn("part", F.lit(0).cast("long")).unionByName(many)
    first = F.col("part") * BUCKET + 1
    one = parts.withColumn("number", F.explode(F.sequence(first, F.least(F.col("m"), first + BUCKET - 1))))
    copies = F.col("whole") + (F.col("number") <= F.col("more")).cast("int")
    return one.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    i, h, source, m, whole, more, row, part, start, n = (free_name(docs, x) for x in ("id", "hash", "source", "rows", "whole", "more", "row", "part", "start", "number"))
    units = mix_units(docs).filter("whole > 0 OR more > 0").select("doc_id", "h", "source", "m", "whole", "more").toDF(i, h, source, m, whole, more)
    same = (_row_hash() == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(source))
    joined = docs.join(units, same)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # rows of which all, or none, take one more copy need no number
    alike = joined.filter((F.col(more) == 0) | (F.col(more) == F.col(m))).withColumn(n, F.col(whole) + (F.col(more) > 0).cast("int"))
    # the others of a unit are numbered in parts of bounded size, and parts by what stands before them
    some = written(joined.filter((F.col(more) > 0) & (F.col(more) < F.col(m))).withColumn(row, F.monotonically_increasing_id()), "equal-rows")
    some = some.withColumn(part, F.pmod(F.xxhash64(row), F.ceil(F.col(m) / F.lit(float(BUCKET)))))
    unit = [i, h, source]
    counts = some.groupBy(*unit, part).agg(F.count(F.lit(1)).alias(start))
    before = F.coalesce(F.sum(start).over(Window.partitionBy(*unit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"{c}_") for c in (*unit, part)], before.alias(start))
    at = F.lit(True)
    for c in (*unit, part):
        at &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    placed = some.join(counts, at).withColumn(n, F.col(start) + F.row_number().over(Window.partitionBy(*unit, part).orderBy(row)))
    placed = placed.withColumn(n, F.col(whole) + (F.col(n) <= F.col(more)).cast("int"))
    both = alike.select(*columns, n).unionByName(placed.select(*columns, n))
    return both.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns)


by_value(__name__)
