"""Potential-proxy screening: association, predictability by hashed folds, strata."""

from __future__ import annotations

from struct import pack

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions import ranked


def fold_of(entity: Column, folds: int, seed: int, protocol: str, domain: str) -> Column:
    """SHA-256 of domain, protocol, seed and entity as a 256-bit number modulo folds, by Horner steps of 32 bits.

    Protocol and entity come after their lengths (32 bits), the seed is 64 bits: no two inputs have the same bytes.
    """
    if folds < 2 or not 0 <= seed < 2**64:
        raise ValueError("folds are two or more, and a seed fits 64 bits")
    own = F.encode(entity.cast("string"), "UTF-8")
    head = domain.encode() + pack(">I", len(protocol.encode())) + protocol.encode() + pack(">Q", seed)
    h = F.sha2(F.concat(F.lit(bytearray(head)), F.unhex(F.lpad(F.hex(F.octet_length(own).cast("long")), 8, "0")), own), 256)
    r = F.lit(0).cast("long")
    for i in range(8):
        word = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        r = (r * 4294967296 + word) % folds
    return r


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the variance (two passes over group means)."""
    by = df.groupBy(F.col(group)).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    mean = by.agg(grand.alias("grand"))
    both = by.join(F.broadcast(mean))  # one row
    between = F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand")))
    return both.agg(F.try_divide(between, between + F.sum(F.col("n") * F.col("v"))).alias("eta_squared"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bias-corrected V; a missing value of ``a`` is a category."""
    cell = df.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("<missing>")).alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    na, nb, n = (F.sum("n").over(Window.partitionBy(*k)) for k in (["a"], ["b"], []))
    t = cell.withColumns({"na": na, "nb": nb, "t": n}).agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("q"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("k"), F.max("t").alias("t"))
    t = t.withColumns({"phi": F.greatest(F.lit(0.0), F.col("q") - 1 - (F.col("r") - 1) * (F.col("k") - 1) / (F.col("t") - 1)), "rc": F.col("r") - (F.col("r") - 1) * (F.col("r") - 1) / (F.col("t") - 1), "kc": F.col("k") - (F.col("k") - 1) * (F.col("k") - 1) / (F.col("t") - 1)})
    return t.select(F.coalesce(F.sqrt(F.try_divide("phi", F.least("rc", "kc") - 1)), F.lit(0.0)).alias("cramers_v"))


def macro_auc(df: DataFrame, label: str, score: str, classes: list[str]) -> DataFrame:
    """Mean of the one-versus-rest AUCs of the classes."""
    long = df.select(F.col(score).alias("s"), F.col(label).alias("label"), F.explode(F.array(*[F.lit(c) for c in classes])).alias("c"))
    per = ranked.auc(long.withColumn("y", F.col("label") == F.col("c")), ["c"], "s", "y")
    return per.agg(F.avg("auc").alias("macro_auc"))
