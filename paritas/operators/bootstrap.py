"""Reproducible bootstrap: a SHA-256 counter stream, exact draws, percentile intervals.

The stream of a key is SHA-256(domain, seed, 0, key, 0, role, counter); each block gives four 64-bit
candidates; a candidate at or beyond the largest multiple of n is skipped and shifts what follows.
Blocks are made in parallel. Skips are so rare (about n / 2^64) that they are collected, and a
position is its place in the stream less the skips before it: no window over the stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.running import running

DOMAIN = "audit-bootstrap-v1\0"


def index_stream(spark: SparkSession, n: int, length: int, seed: int, key: str, role: str, domain: str = DOMAIN) -> DataFrame:
    """(position, index): the first ``length`` indices of the stream."""
    material = f"{domain}{seed}\0{key}\0{role}".encode()
    limit = 2**64 - 2**64 % n
    share = (2**64 - limit) / 2**64  # of candidates that are skipped
    block = spark.range(int(1.2 * length / 4 / (1 - share)) + 16 if share > 1e-9 else -(-length // 4) + 4)
    h = F.sha2(F.concat(F.lit(bytearray(material)), F.unhex(F.lpad(F.hex("id"), 16, "0"))), 256)
    words = block.select("id", F.posexplode(F.array(*[F.conv(F.substring(h, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)])).alias("k", "c"))
    words = words.select((F.col("id") * 4 + F.col("k")).alias("at"), "c")
    skipped = [r[0] for r in words.filter(F.col("c") >= F.lit(str(limit)).cast("decimal(20,0)")).select("at").collect()] if limit != 2**64 else []
    at = F.col("at") - sum(((F.col("at") > s).cast("long") for s in skipped), F.lit(0))
    kept = words.filter(~F.col("at").isin(skipped)) if skipped else words
    return kept.select(at.cast("long").alias("position"), (F.col("c") % F.lit(n).cast("decimal(20,0)")).cast("long").alias("index")).filter(F.col("position") < length)


def draws(spark: SparkSession, n: int, resamples: int, seed: int, key: str, role: str = "scope", domain: str = DOMAIN) -> DataFrame:
    """(draw, i, index), draw-major."""
    s = index_stream(spark, n, n * resamples, seed, key, role, domain)
    return s.select(F.floor(F.col("position") / n).cast("long").alias("draw"), (F.col("position") % n).alias("i"), "index")


def with_ordinal(rows: DataFrame, order: str, keys: list[str] | None = None, few: int | None = None) -> DataFrame:
    """0-based positions in eligible order (of each key), which the draws refer to."""
    return running(rows, keys or [], [F.asc_nulls_first(order)], {"index": F.lit(1).cast("long")}, few=few)


def interval(values: DataFrame, keys: list[str], confidence: float, minimum_valid: int) -> DataFrame:
    """Type-7 percentile interval of ``v`` over valid draws; null bounds where they are too few."""
    a = (1 - confidence) / 2
    ok = F.col("v").isNotNull() & ~F.isnan("v")
    q = F.percentile(F.when(ok, F.col("v")), F.array(F.lit(a), F.lit(1 - a)))
    out = values.groupBy(*keys).agg(q.alias("q"), F.sum(ok.cast("long")).alias("valid"))
    enough = F.col("valid") >= minimum_valid
    return out.select(*keys, "valid", F.when(enough, F.col("q")[0]).alias("lower"), F.when(enough, F.col("q")[1]).alias("upper"))


def selection_rate_draws(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """(draw, v) from rows (index, d)."""
    return sample.join(rows.select("index", F.col("d").cast("double").alias("x")), "index").groupBy("draw").agg(F.avg("x").alias("v"))


def multinomial(spark: SparkSession, cells: list[int], resamples: int, seed: int) -> DataFrame:
    """(draw, tp, fp, fn, tn): draws of the four cells, equal in distribution to resampling rows.

    Work is per draw and not per row: an unweighted rate depends on its cells only.
    """
    n = sum(cells)
    share = [c / n for c in cells]

    def run(batches):
        for b in batches:
            out = np.array([np.random.default_rng([seed, int(i)]).multinomial(n, share) for i in b["id"]]).reshape(-1, 4)
            yield pd.DataFrame({"draw": b["id"], **dict(zip(("tp", "fp", "fn", "tn"), out.T, strict=True))})

    return spark.range(resamples).mapInPandas(run, "draw long, tp long, fp long, fn long, tn long")
