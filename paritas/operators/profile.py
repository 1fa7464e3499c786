"""Single-run profiles and drift between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions import exact, running, typed

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def missingness(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(field, scope, missing, total, rate): overall and by group, over the input population."""
    per = df.groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("total"), *[F.sum(typed.missing(df, c).cast("long")).alias(f"m_{c}") for c in columns])
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m_{c}").alias("missing")) for c in columns])
    scopes = F.array_compact(F.array(F.lit("overall"), F.concat(F.lit("group:"), F.col("g"))))
    long = per.withColumn("f", F.explode(fields)).withColumn("scope", F.explode(scopes))
    out = long.groupBy("f.field", "scope").agg(F.sum("f.missing").alias("missing"), F.sum("total").alias("total"))
    return out.withColumn("rate", F.try_divide("missing", "total"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(minimum, maximum, mean, deviation, quantiles): moments by exact sums, quantiles by rank over runs of equal values."""
    c = F.col(column).cast("double")
    rows = df.select(c.alias("c"))
    moments = exact.moments(rows, [], "c")
    ranks = running.quantiles(rows, [], "c", list(QUANTILES))
    q = F.col("quantiles")
    return moments.join(F.broadcast(ranks), how="left").select(q[0].alias("minimum"), q[len(QUANTILES) - 1].alias("maximum"), "mean", "deviation", "quantiles")  # one row each


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Strict Tukey fences over type-7 quartiles."""
    rows = df.select(F.col(column).cast("double").alias("c"))
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    fence = running.quantiles(rows, [], "c", [0.25, 0.75]).select((q1 - 1.5 * (q3 - q1)).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high"))
    both = rows.join(F.broadcast(fence), how="left")  # one row
    return both.agg(F.max("low").alias("lower_fence"), F.max("high").alias("upper_fence"), F.sum((F.col("c") < F.col("low")).cast("long")).alias("below"), F.sum((F.col("c") > F.col("high")).cast("long")).alias("above"), F.count("c").alias("total"))


def counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share); the table of values is small against the rows, its total is a join of one row."""
    by = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("total")))).select("value", "n", F.try_divide("n", "total").alias("share"))


def facets(df: DataFrame, score: str, outcome: str, group: str, columns: list[str]) -> DataFrame:
    """A profile as tidy facets (code, scope, measure)."""
    g = counts(df, group).select(F.lit("group_proportion").alias("code"), F.col("value").alias("scope"), F.col("share").alias("measure"))
    m = missingness(df, columns, group).select(F.lit("missingness_rate").alias("code"), F.concat_ws("|", "field", "scope").alias("scope"), F.col("rate").alias("measure"))
    q = distribution(df, score).select(F.posexplode("quantiles").alias("i", "measure"))
    q = q.select(F.lit("score_quantile").alias("code"), F.element_at(F.array(*[F.lit(str(x)) for x in QUANTILES]), F.col("i") + 1).alias("scope"), "measure")
    o = counts(df, outcome).select(F.lit("outcome_proportion").alias("code"), F.col("value").alias("scope"), F.col("share").alias("measure"))
    return g.unionByName(m).unionByName(q).unionByName(o)


def drift(current: DataFrame, baseline: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Facets of both profiles side by side; a change at or beyond the code's limit is flagged."""
    c, b = (x.select("code", "scope", F.col("measure").alias(n)) for x, n in ((current, "current"), (baseline, "baseline")))
    both = c.join(b, ["code", "scope"], "full_outer")
    proportion = F.col("code").isin("group_proportion", "outcome_proportion")
    both = both.withColumns({n: F.when(proportion, F.coalesce(n, F.lit(0.0))).otherwise(F.col(n)) for n in ("current", "baseline")})
    limit = F.coalesce(*[F.when(F.col("code") == k, F.lit(v)) for k, v in limits.items()])
    change = F.abs(F.col("current") - F.col("baseline"))
    status = F.when(change.isNull(), "not_computable").when(change >= limit, "changed").otherwise("stable")
    return both.select("code", "scope", "current", "baseline", status.alias("status"))
