"""Authoritative records: links between versions of a record, their roots, and the version that counts.

A record is known by (source_id, source_version, record_id); it may revise one record and reverse one.
Links are checked as joins on unique keys. Roots are found by pointer doubling: after k rounds a record
points 2 ** k links up, so a chain of n links takes log2(n) rounds, each one join over the records that have
not arrived. A round in which none arrives means that all that are left go round in a cycle. A record that
very many others link to is one row on the join's other side, so skewed partitions can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.running import checkpointed
from paritas.operators.altdata import feature_gate, instant

KEY = ["source_id", "source_version", "record_id"]
#: The faults of links, in the order in which a record is checked.
FAULTS = (
    "ad_source_not_declared", "ad_source_family_mismatch", "ad_source_version_mismatch", "ad_duplicate_record_identity",
    "ad_revision_target_missing", "ad_reversal_target_missing", "ad_linkage_family_mismatch", "ad_non_monotonic_history",
)


def link_faults(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, code): the first fault of each faulty record, cycles aside (see ``revision_roots``).

    ``sources`` has (source_id, source_version, signal_family), one row a source; ``records`` have the key,
    entity_id, signal_family, currency, observed_at, revision_of and reversal_of.
    """
    known = sources.select("source_id", F.col("source_version").alias("__version"), F.col("signal_family").alias("__family"))
    # of a repeated record, which is a fault itself, the least is the target; one aggregate, shuffled once
    target = records.groupBy(*KEY).agg(F.min(F.struct("entity_id", "signal_family", "currency", "observed_at")).alias("__at"), F.count(F.lit(1)).alias("__times"))
    df = records.join(known, "source_id", "left").join(target.select(*KEY, "__times"), KEY)
    tests = [
        F.col("__version").isNull(),
        F.col("signal_family") != F.col("__family"),
        F.col("source_version") != F.col("__version"),
        F.col("__times") > 1,
    ]
    links = []
    for k in ("revision_of", "reversal_of"):
        side = target.select("source_id", "source_version", F.col("record_id").alias(k), F.col("__at").alias(f"__{k}"))
        df = df.join(side, ["source_id", "source_version", k], "left")
        linked, at = F.col(k).isNotNull(), F.col(f"__{k}")
        other = (at["entity_id"] != F.col("entity_id")) | (at["signal_family"] != F.col("signal_family")) | (at["currency"] != F.col("currency"))
        links.append((linked & at.isNull(), linked & other, linked & (at["observed_at"] > F.col("observed_at"))))
    both = F.col("revision_of").isNotNull() & F.col("reversal_of").isNotNull() & (F.col("revision_of") != F.col("reversal_of"))
    # a revision's faults come before those of a reversal
    (missing, differs, late), (missing2, differs2, late2) = links
    order = [*zip(tests, FAULTS[:4]), (missing, FAULTS[4]), (differs, FAULTS[6]), (late, FAULTS[7]), (missing2, FAULTS[5]), (differs2, FAULTS[6]), (late2, FAULTS[7]), (both, FAULTS[7])]
    code = F.coalesce(*[F.when(test, F.lit(name)) for test, name in order])
    return df.select(*KEY, code.alias("code")).filter("code IS NOT NULL")


def climb(links: DataFrame) -> DataFrame:
    """(key, root, depth, cyclic) of each linked record, from rows (key, parent) with one parent a record."""
    at = ["source_id", "source_version"]
    now = checkpointed(links.select(*KEY, F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")))
    left = None
    while True:
        up = now.select(*at, F.col("record_id").alias("root"), F.col("root").alias("__top"), F.col("depth").alias("__more"), F.col("done").alias("__done"))
        step = now.filter("NOT done").join(up, [*at, "root"], "left").select(
            *KEY, F.coalesce("__top", "root").alias("root"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth"), F.coalesce("__done", F.lit(True)).alias("done")
        )
        now = checkpointed(now.filter("done").unionByName(step))
        before, left = left, now.filter("NOT done").count()
        if left in (0, before):  # none has arrived: the others go round
            return now.select(*KEY, F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), (~F.col("done")).alias("cyclic"))


def revision_roots(records: DataFrame) -> DataFrame:
    """(key, root, depth, cyclic): along revisions; ``cyclic`` looks at revisions and reversals together.

    A record without a revision is its own root at depth 0. A cyclic record's root is null.
    """
    roots = climb(records.filter("revision_of IS NOT NULL").select(*KEY, F.col("revision_of").alias("parent")))
    linked = climb(records.select(*KEY, F.coalesce("revision_of", "reversal_of").alias("parent")).filter("parent IS NOT NULL"))
    out = records.select(*KEY).join(roots.withColumnRenamed("cyclic", "__c"), KEY, "left").join(linked.select(*KEY, "cyclic"), KEY, "left")
    none = F.col("__c").isNull()
    return out.select(*KEY, F.when(none, F.col("record_id")).otherwise(F.col("root")).alias("root"), F.when(none, F.lit(0)).otherwise(F.col("depth")).cast("long").alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def eligible_terminal(records: DataFrame, as_of: Column, execution: Column) -> DataFrame:
    """Eligible records that no eligible record revises. Dates end with their day."""
    end = instant(F.col("evidence_end"), end=dict(records.dtypes)["evidence_end"] == "date")
    gate = feature_gate(instant(F.col("evidence_start")), end, F.col("observed_at"), F.col("revision_of").isNotNull(), F.col("status"), as_of, execution)
    fit = records.filter(gate["disposition"] == "eligible")
    revised = fit.filter("revision_of IS NOT NULL").select("source_id", "source_version", F.col("revision_of").alias("record_id")).distinct()
    return fit.join(revised, KEY, "left_anti")


def level_links(records: DataFrame) -> DataFrame:
    """(key, parent): the links that can be part of a cycle, of records without faults: no target is later than its record.

    So the times along a cycle are equal, and a link to an earlier record is in none. A record without a time says
    nothing of those around it: where there is one, all links are looked at.
    """
    links = records.select(*KEY, "observed_at", F.coalesce("revision_of", "reversal_of").alias("parent")).filter("parent IS NOT NULL")
    if records.filter("observed_at IS NULL").isEmpty():
        target = records.select("source_id", "source_version", F.col("record_id").alias("parent"), F.col("observed_at").alias("__at"))
        links = links.join(target, ["source_id", "source_version", "parent"]).filter("__at >= observed_at")
    return links.select(*KEY, "parent")


def checked_roots(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, root) of every record; raises the first fault's code where links are faulty."""
    faults = {r.code for r in link_faults(records, sources).select("code").distinct().collect()}  # eight codes at most
    if faults:
        raise ValueError(min(faults, key=FAULTS.index))
    if not climb(level_links(records)).filter("cyclic").isEmpty():
        raise ValueError(FAULTS[7])
    roots = climb(records.filter("revision_of IS NOT NULL").select(*KEY, F.col("revision_of").alias("parent"))).select(*KEY, "root")
    return checkpointed(records.select(*KEY).join(roots, KEY, "left").withColumn("root", F.coalesce("root", "record_id")))


def latest_by_root(terminal: DataFrame, roots: DataFrame, times_must_differ: bool = True) -> DataFrame:
    """(source_id, source_version, root, record_id): the terminal record of each root that was observed last."""
    group = ["source_id", "source_version", "root"]
    last = terminal.join(roots, KEY).groupBy(*group, "observed_at").agg(F.count(F.lit(1)).alias("__n"), F.min("record_id").alias("record_id"))
    if times_must_differ:
        last = checkpointed(last)
        if not last.filter("__n > 1").isEmpty():
            raise ValueError(FAULTS[7])
    # one struct a root: a partial maximum before the shuffle
    chosen = last.groupBy(*group).agg(F.max(F.struct("observed_at", "record_id")).alias("__last"))
    return chosen.select(*group, F.col("__last.record_id").alias("record_id"))


def authoritative_records(records: DataFrame, sources: DataFrame, as_of: Column, execution: Column, roots: DataFrame | None = None) -> DataFrame:
    """The latest eligible terminal version below each revision root, with ``root``; raises the first fault's code.

    Two terminal versions of one root that were observed at one time are a fault: neither is later.
    """
    if roots is None:
        records = checkpointed(records)  # read many times from here on
        roots = checked_roots(records, sources)
    return records.join(latest_by_root(eligible_terminal(records, as_of, execution), roots), KEY)
