"""Bootstrap intervals of all metrics of an audit in one pass over their draws.

Each metric has its own stream of positions, and a comparison has two, of its group and of its reference, paired
by draw. All streams are made, met with the rows at their positions, and counted together: a draw is its
weights by outcome and decision, and for the area under the curve its multiplicities by score. Metrics are
then formulas over these small tables. Work is rows times resamples for each stream, in parallel over blocks of
it; nothing but intervals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.running import checkpointed
from paritas.operators import bootstrap
from paritas.operators.metrics import ordered_sum

#: Blocks of four positions that one row unfolds into.
CHUNK = 2048
RATES = {
    "selection_rate": ("tp + fp", "tp + fp + fn + tn"), "denial_rate": ("fn + tn", "tp + fp + fn + tn"), "accuracy": ("tp + tn", "tp + fp + fn + tn"), "precision": ("tp", "tp + fp"),
    "true_positive_rate": ("tp", "tp + fn"), "false_positive_rate": ("fp", "fp + tn"), "false_negative_rate": ("fn", "tp + fn"), "brier_score": ("sq", "tp + fp + fn + tn"),
}
COMPARED = {
    "selection_rate_difference": "sr - sr_r", "demographic_parity_difference": "sr - sr_r", "adverse_impact_ratio": "try_divide(sr, sr_r)",
    "equal_opportunity_difference": "tpr - tpr_r", "equalized_odds_gap": "IF(tpr IS NULL OR tpr_r IS NULL OR fpr IS NULL OR fpr_r IS NULL, NULL, greatest(abs(tpr - tpr_r), abs(fpr - fpr_r)))",
}


def numbered_scopes(placed: DataFrame) -> DataFrame:
    """(scope, attribute, value, n): the scopes of ``placed`` by number."""
    sizes = placed.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    return checkpointed(sizes.withColumn("scope", F.row_number().over(Window.orderBy("attribute", "value"))))  # a row a group


def numbered_streams(scopes: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (with key, role, attribute, value) that have rows, each with its ``stream``, ``scope`` and ``n``."""
    known = requests.join(F.broadcast(scopes), ["attribute", "value"]).filter("n > 0")  # a row a metric and group
    return checkpointed(known.withColumn("stream", F.row_number().over(Window.orderBy("key", "role"))))


def positions(streams: DataFrame, resamples: int, seed: int, domain: str) -> DataFrame:
    """(scope, index, stream, draw) of every stream; a candidate that a stream skips has a draw below 0.

    A skip shifts what follows; it is so rare (n in 2 ** 64) that draws are made as if there were none, and the mark
    says whether they are right.
    """
    blocks = F.ceil(F.col("n") * resamples / 4)
    # by number: a stream's chunks are so few bytes that they would be put together in one task
    spark = streams.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    chunks = streams.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((blocks - 1) / CHUNK)))).repartition(parts, "stream", "chunk")
    first = F.col("chunk") * CHUNK
    rows = chunks.withColumn("id", F.explode(F.sequence(first, F.least(first + CHUNK, blocks.cast("long")) - 1)))
    material = F.concat(F.lit(bytearray(f"{domain}{seed}\0".encode())), F.encode("key", "UTF-8"), F.lit(bytearray(b"\0")), F.encode("role", "UTF-8"), F.unhex(F.lpad(F.hex("id"), 16, "0")))
    rows = rows.withColumn("h", F.sha2(material, 256))
    half = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    rows = rows.select("stream", "scope", "n", "id", F.posexplode(F.array(*[F.struct(half[2 * i].alias("hi"), half[2 * i + 1].alias("lo")) for i in range(4)])).alias("k", "c"))
    # unsigned: the remainder of two halves of 32 bits, for up to 2 ** 31 rows
    n, word = F.col("n"), F.lit(1 << 32)
    rest = (F.col("c.hi") % n * (word % n) + F.col("c.lo")) % n
    # the candidates from 2 ** 64 less the remainder of 2 ** 64 on are skipped
    spare = (word % n) * (word % n) % n
    over = (F.col("c.hi") == word - 1) & (F.col("c.lo") >= word - spare) & (spare > 0)
    draw = F.floor((F.col("id") * 4 + F.col("k")) / n).cast("int")
    return rows.select("scope", rest.cast("int").alias("index"), "stream", draw.alias("draw"), over.alias("over")).filter(F.col("draw") < resamples).select("scope", "index", "stream", F.when(F.col("over"), -1 - F.col("draw")).otherwise(F.col("draw")).alias("draw"))


def drawn(placed: DataFrame, scopes: DataFrame, streams: DataFrame, resamples: int, seed: int, domain: str) -> DataFrame:
    """Rows of ``placed`` (attribute, value, index and others) at the positions of every stream, with ``stream`` and ``draw``.

    A stream is unfolded from one row, which Spark takes for a small table and would broadcast; it is as long
    as the rows times the resamples. Both sides are shuffled, and the rows are the side that is hashed.
    """
    here = placed.join(F.broadcast(scopes.select("scope", "attribute", "value")), ["attribute", "value"]).drop("attribute", "value").withColumn("index", F.col("index").cast("int"))
    return positions(streams, resamples, seed, domain).join(here.hint("shuffle_hash"), ["scope", "index"])


def cells(rows: DataFrame, requests: DataFrame, resamples: int, seed: int, domain: str, order: str, few: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per (key, role, draw) the weights by cell; and per (key, draw, score) those by outcome, for areas under curves.

    ``rows`` are (attribute, value, y, d, s, w, ``order``), once for each scope that they belong to.
    """
    placed = checkpointed(bootstrap.with_ordinal(rows, order, ["attribute", "value"], few))
    scopes = numbered_scopes(placed)
    streams = numbered_streams(scopes, requests)
    met = drawn(placed.select("attribute", "value", "index", "y", "d", "s", "w"), scopes, streams, resamples, seed, domain)
    met = met.join(F.broadcast(streams.select("stream", "metric")), "stream")
    ranked = F.when(F.col("metric") == "roc_auc", F.col("s"))
    y, d, w = F.col("y"), F.col("d"), F.col("w")
    gap = F.col("s") - y.cast("double")
    sums = {"tp": y & d, "fp": ~y & d, "fn": y & ~d, "tn": ~y & ~d}
    by = met.groupBy("stream", "draw", ranked.alias("s")).agg(*[F.sum(F.when(c, w).otherwise(0.0)).alias(k) for k, c in sums.items()], ordered_sum(w * gap * gap).alias("sq"))
    by = checkpointed(by)
    if not by.filter("draw < 0").isEmpty():
        raise ValueError("a stream skips a candidate: draw this metric with bootstrap.draws")
    by = by.join(F.broadcast(streams.select("stream", "key", "metric", "role")), "stream").drop("stream")
    return by.filter("metric <> 'roc_auc'"), by.filter("metric = 'roc_auc'")


def _ratio(a: str, b: str) -> Column:
    return F.expr(f"try_divide({a}, {b})")


def intervals(rows: DataFrame, requests: DataFrame, resamples: int, seed: int, domain: str, order: str, confidence: float, minimum_valid: int, few: int | None = None) -> DataFrame:
    """(key, valid, lower, upper) of each requested metric, in one pass.

    ``requests`` has (key, metric, role, attribute, value): one row with role ``scope``, or two with ``comparison`` and ``reference``.
    """
    counted, scored = cells(rows, requests, resamples, seed, domain, order, few)
    own = F.coalesce(*[F.when(F.col("metric") == m, _ratio(a, b)) for m, (a, b) in RATES.items()])
    values = counted.filter("role = 'scope'").select("key", own.alias("v"))
    rates = counted.filter("role <> 'scope'").select("key", "metric", "role", "draw", *[_ratio(*RATES[m]).alias(k) for k, m in (("sr", "selection_rate"), ("tpr", "true_positive_rate"), ("fpr", "false_positive_rate"))])
    left = rates.filter("role = 'comparison'").drop("role")
    right = rates.filter("role = 'reference'").select("key", "draw", *[F.col(c).alias(f"{c}_r") for c in ("sr", "tpr", "fpr")])
    paired = left.join(right, ["key", "draw"])
    values = values.unionByName(paired.select("key", F.coalesce(*[F.when(F.col("metric") == m, F.expr(v)) for m, v in COMPARED.items()]).alias("v")))
    # a draw's tie runs are one window; draws are apart
    runs = scored.select("key", "draw", "s", (F.col("tp") + F.col("fn")).alias("f"), (F.col("fp") + F.col("tn")).alias("u"))
    below = F.coalesce(F.sum("u").over(Window.partitionBy("key", "draw").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    areas = runs.withColumn("below", below).groupBy("key", "draw").agg(F.try_divide(F.sum(F.col("f") * (F.col("below") + 0.5 * F.col("u"))), F.sum("f") * F.sum("u")).alias("v"))
    return bootstrap.interval(values.unionByName(areas.select("key", "v")), ["key"], confidence, minimum_valid)
