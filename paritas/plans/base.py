"""Base tables of the registered queries, drawn from the star schema, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ALLOWED = {"grp": SEGMENTS, "prio": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]}
REFERENCE = {"grp": "BUILDING", "prio": "3-MEDIUM"}
AS_OF, EXECUTION = "2024-01-20 00:00:00", "2024-01-25 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def audit(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, grp, prio, y, d, s, w): orders with their customer's segment."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = (F.col("o_orderkey") * 37) % 101
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("entity_id"), F.col("c_mktsegment").alias("grp"), F.col("o_orderpriority").alias("prio"),
        (F.col("o_orderstatus") == "F").alias("y"), (k >= 50).alias("d"), (k / F.lit(100.0)).alias("s"), (1 + F.col("o_orderkey") % 5).cast("double").alias("w"),
    )


AUDIT = """base AS (SELECT o_orderkey AS entity_id, c_mktsegment AS grp, o_orderpriority AS prio, o_orderstatus = 'F' AS y,
  (o_orderkey * 37) % 101 >= 50 AS d, ((o_orderkey * 37) % 101) / 100.0::DOUBLE AS s, (1 + o_orderkey % 5)::DOUBLE AS w
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Rows with planted faults: missing scores, infinite scores, repeated ids, unknown groups."""
    k = F.col("entity_id")
    return audit(spark, d).select(
        (k - (k % 50 == 7).cast("long")).alias("id"), F.when(k % 13 != 0, F.col("grp")).alias("grp"), F.col("y").cast("int").alias("y"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 101 == 3, F.lit(float("inf"))).otherwise(F.col("s")).alias("s"), F.col("d").cast("int").alias("d"),
    )


RAW = AUDIT + """, raw AS (SELECT entity_id - (entity_id % 50 = 7)::INT AS id, CASE WHEN entity_id % 13 <> 0 THEN grp END AS grp, y::INT AS y,
  CASE WHEN entity_id % 17 = 0 THEN NULL WHEN entity_id % 101 = 3 THEN 'inf'::DOUBLE ELSE s END AS s, d::INT AS d FROM base),
flags AS (SELECT *, id IS NULL OR grp IS NULL OR s IS NULL OR y IS NULL OR d IS NULL AS missing_required_value,
  grp IS NOT NULL AND grp NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') AS unknown_protected_group,
  id IS NOT NULL AND count(*) OVER (PARTITION BY id) > 1 AS duplicate_record, coalesce(abs(s) = 'inf'::DOUBLE, false) AS non_finite_numeric,
  y IS NOT NULL AND y NOT IN (1) AS unexpected_category FROM raw),
marked AS (SELECT *, missing_required_value OR unknown_protected_group OR duplicate_record OR non_finite_numeric OR unexpected_category AS excluded FROM flags)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Events as signal records of four sources, with revisions, late observations and pending rows."""
    e, k = table(spark, d, "events"), F.col("event_id")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("inflow", "outflow", "fee", "inflow", "outflow")]), (k % 5 + 1).cast("int"))
    return e.select(
        k.alias("record_id"), (k % 4).alias("source_id"), F.col("user_id").alias("entity_id"), kinds.alias("event_type"), F.col("ts").alias("event_time"),
        (F.col("ts") + F.expr("make_interval(0, 0, 0, CAST(event_id % 9 AS INT))")).alias("observed_at"), F.col("value").alias("amount"),
        F.when((k % 40 == 39) & (k >= 40), k - 40).alias("revision_of"), F.when(k % 23 == 0, "pending").otherwise("posted").alias("status"),
    )


SIGNALS = """signals AS (SELECT event_id AS record_id, event_id % 4 AS source_id, user_id AS entity_id,
  ['inflow', 'outflow', 'fee', 'inflow', 'outflow'][event_id % 5 + 1] AS event_type, ts AS event_time, ts + to_days((event_id % 9)::INT) AS observed_at,
  value AS amount, CASE WHEN event_id % 40 = 39 AND event_id >= 40 THEN event_id - 40 END AS revision_of,
  CASE WHEN event_id % 23 = 0 THEN 'pending' ELSE 'posted' END AS status FROM events)"""
