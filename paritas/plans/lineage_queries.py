"""Queries over versions of records, drawn from the orders of a customer: name -> (DataFrame, SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paritas.operators import lineage
from paritas.plans.base import table

AS_OF, EXECUTION = "2024-01-09 12:00:00", "2024-01-14 00:00:00"


def versions(s, d):
    """A customer's orders as versions of signal records: an order may revise or reverse an earlier one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select("*", F.row_number().over(w).alias("i"), F.lag("o_orderkey", 1).over(w).alias("p1"), F.lag("o_orderkey", 2).over(w).alias("p2"))
    revises = F.when(k % 7 == 0, F.col("p2")).when(k % 3 != 0, F.col("p1"))
    day = F.expr("DATE'2024-01-01' + CAST(i - 1 AS INT)")
    return o.select(
        (F.col("o_custkey") % 4).alias("source_id"), F.lit("1.0").alias("source_version"), k.alias("record_id"), F.col("o_custkey").alias("entity_id"),
        F.when(F.col("o_custkey") % 2 == 0, "rent").otherwise("utility").alias("signal_family"), F.lit("USD").alias("currency"), day.alias("evidence_start"), day.alias("evidence_end"),
        (day.cast("timestamp") + F.expr("make_interval(0, 0, 0, 1, CAST(o_orderkey % 5 AS INT))")).alias("observed_at"), F.when(k % 23 == 0, "pending").otherwise("posted").alias("status"),
        revises.alias("revision_of"), F.when(revises.isNull() & (k % 2 == 0), F.col("p1")).alias("reversal_of"),
    )


def sources(s):
    return s.createDataFrame([(i, "1.0", "rent" if i % 2 == 0 else "utility") for i in range(4)], "source_id long, source_version string, signal_family string")


VERSIONS = """o AS (SELECT *, row_number() OVER w AS i, lag(o_orderkey, 1) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
v0 AS (SELECT o_custkey % 4 AS source_id, '1.0' AS source_version, o_orderkey AS record_id, o_custkey AS entity_id, CASE WHEN o_custkey % 2 = 0 THEN 'rent' ELSE 'utility' END AS signal_family, 'USD' AS currency,
  TIMESTAMP '2024-01-01' + to_days((i - 1)::INT) AS a, TIMESTAMP '2024-01-01' + to_days(i::INT) - INTERVAL 1 MICROSECOND AS b, TIMESTAMP '2024-01-01' + to_days(i::INT) + to_hours((o_orderkey % 5)::INT) AS observed_at,
  CASE WHEN o_orderkey % 23 = 0 THEN 'pending' ELSE 'posted' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN p2 WHEN o_orderkey % 3 <> 0 THEN p1 END AS revision_of, o_orderkey % 2 = 0 AS even, p1 FROM o),
v AS (SELECT * EXCLUDE (even, p1), CASE WHEN revision_of IS NULL AND even THEN p1 END AS reversal_of FROM v0)"""
#: Each record up its revisions, and up all its links, a step at a time.
ROOTS = VERSIONS + """, r AS (SELECT source_id, record_id, record_id AS up, 0::BIGINT AS depth FROM v
  UNION ALL SELECT r.source_id, r.record_id, v.revision_of, r.depth + 1 FROM r JOIN v ON v.source_id = r.source_id AND v.record_id = r.up WHERE v.revision_of IS NOT NULL),
roots AS (SELECT source_id, record_id, arg_max(up, depth) AS root, max(depth) AS depth FROM r GROUP BY 1, 2)"""


def _faulty(s, d):
    k = F.col("record_id")
    v = versions(s, d).withColumns({
        "source_id": F.when(k % 101 == 0, 9).otherwise(F.col("source_id")), "signal_family": F.when(k % 103 == 0, "cash_flow").otherwise(F.col("signal_family")),
        "source_version": F.when(k % 107 == 0, "2.0").otherwise(F.col("source_version")), "currency": F.when(k % 31 == 0, "EUR").otherwise(F.col("currency")),
        "observed_at": F.when(k % 37 == 0, F.col("observed_at") + F.expr("INTERVAL 9 DAY")).otherwise(F.col("observed_at")), "reversal_of": F.when(k % 41 == 0, k + 1).otherwise(F.col("reversal_of")),
    })
    return v.withColumn("record_id", F.when(k % 109 == 0, F.coalesce("revision_of", "record_id")).otherwise(k))


_FAULTY = VERSIONS + """, f0 AS (SELECT * REPLACE (CASE WHEN record_id % 101 = 0 THEN 9 ELSE source_id END AS source_id, CASE WHEN record_id % 103 = 0 THEN 'cash_flow' ELSE signal_family END AS signal_family,
  CASE WHEN record_id % 107 = 0 THEN '2.0' ELSE source_version END AS source_version, CASE WHEN record_id % 31 = 0 THEN 'EUR' ELSE currency END AS currency,
  CASE WHEN record_id % 37 = 0 THEN observed_at + INTERVAL 9 DAY ELSE observed_at END AS observed_at, CASE WHEN record_id % 41 = 0 THEN record_id + 1 ELSE reversal_of END AS reversal_of) FROM v),
f AS (SELECT * REPLACE (CASE WHEN record_id % 109 = 0 THEN coalesce(revision_of, record_id) ELSE record_id END AS record_id) FROM f0),
n AS (SELECT *, count(*) OVER (PARTITION BY source_id, source_version, record_id) AS times FROM f),
t AS (SELECT DISTINCT ON (source_id, source_version, record_id) *, true AS c FROM f ORDER BY source_id, source_version, record_id, entity_id, signal_family, currency, observed_at),
x AS (SELECT n.*, p.c IS NOT NULL AS pt, q.c IS NOT NULL AS qt, p.entity_id <> n.entity_id OR p.signal_family <> n.signal_family OR p.currency <> n.currency AS po, q.entity_id <> n.entity_id OR q.signal_family <> n.signal_family OR q.currency <> n.currency AS qo,
  p.observed_at > n.observed_at AS pl, q.observed_at > n.observed_at AS ql FROM n
  LEFT JOIN t p ON p.source_id = n.source_id AND p.source_version = n.source_version AND p.record_id = n.revision_of LEFT JOIN t q ON q.source_id = n.source_id AND q.source_version = n.source_version AND q.record_id = n.reversal_of),
y AS (SELECT record_id, CASE WHEN source_id > 3 THEN 'ad_source_not_declared' WHEN signal_family <> CASE WHEN source_id % 2 = 0 THEN 'rent' ELSE 'utility' END THEN 'ad_source_family_mismatch'
  WHEN source_version <> '1.0' THEN 'ad_source_version_mismatch' WHEN times > 1 THEN 'ad_duplicate_record_identity' WHEN revision_of IS NOT NULL AND NOT pt THEN 'ad_revision_target_missing' WHEN po THEN 'ad_linkage_family_mismatch' WHEN pl THEN 'ad_non_monotonic_history'
  WHEN reversal_of IS NOT NULL AND NOT qt THEN 'ad_reversal_target_missing' WHEN qo THEN 'ad_linkage_family_mismatch' WHEN ql THEN 'ad_non_monotonic_history' WHEN revision_of <> reversal_of THEN 'ad_non_monotonic_history' END AS code FROM x)"""

QUERIES = {
    "revision_roots": (
        lambda s, d: lineage.revision_roots(versions(s, d)).select("source_id", "record_id", "root", "depth", "cyclic"),
        f"WITH RECURSIVE {ROOTS} SELECT source_id, record_id, root, depth, false AS cyclic FROM roots",
    ),
    "authoritative_records": (
        lambda s, d: lineage.authoritative_records(versions(s, d), sources(s), F.lit(AS_OF).cast("timestamp"), F.lit(EXECUTION).cast("timestamp")).select("source_id", "entity_id", "record_id", "observed_at"),
        f"""WITH RECURSIVE {ROOTS}, e AS (SELECT * FROM v WHERE b <= '{EXECUTION}'::TIMESTAMP AND observed_at <= '{EXECUTION}'::TIMESTAMP AND b <= '{AS_OF}'::TIMESTAMP AND observed_at <= '{AS_OF}'::TIMESTAMP AND status <> 'pending'),
        t AS (SELECT e.*, root FROM e JOIN roots USING (source_id, record_id) WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.source_id = e.source_id AND x.revision_of = e.record_id))
        SELECT source_id, entity_id, record_id, observed_at FROM t QUALIFY row_number() OVER (PARTITION BY source_id, root ORDER BY observed_at DESC) = 1""",
    ),
    "link_faults": (
        lambda s, d: lineage.link_faults(_faulty(s, d), sources(s)).select("record_id", "code"),
        f"WITH {_FAULTY} SELECT record_id, code FROM y WHERE code IS NOT NULL",
    ),
}
