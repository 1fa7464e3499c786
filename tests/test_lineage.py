"""Links, roots and authoritative versions against a plain walk."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paritas.operators import lineage

SCHEMA = "source_id string, source_version string, record_id string, entity_id string, signal_family string, currency string, evidence_start date, evidence_end date, observed_at timestamp, status string, revision_of string, reversal_of string, root string"
SOURCES = [("s", "1", "rent"), ("t", "2", "utility")]
AS_OF, EXECUTION = datetime(2025, 1, 20, 12), datetime(2025, 2, 1)


def record(i, day=1, seen=None, revises=None, reverses=None, status="posted", source="s", **more):
    version, family = {"s": ("1", "rent"), "t": ("2", "utility"), "x": ("1", "rent")}[source]
    at = datetime(2025, 1, day)
    r = {"source_id": source, "source_version": version, "record_id": i, "entity_id": "e", "signal_family": family, "currency": "USD", "evidence_start": at.date(), "evidence_end": at.date(), "observed_at": at + timedelta(days=1 if seen is None else seen), "status": status, "revision_of": revises, "reversal_of": reverses, "root": "clash"}
    return tuple((r | more).values())


@pytest.fixture(scope="module")
def frames(spark):
    sources = spark.createDataFrame(SOURCES, "source_id string, source_version string, signal_family string")
    return lambda rows: (spark.createDataFrame(rows, SCHEMA).drop("root"), sources)


def chosen(frames, rows):
    got = lineage.authoritative_records(*frames(rows), F.lit(AS_OF), F.lit(EXECUTION))
    return {(r.source_id, r.record_id, r.root) for r in got.collect()}


@pytest.mark.parametrize(
    "rows,code",
    [
        ([record("a", source="x")], "ad_source_not_declared"),
        ([record("a", signal_family="utility")], "ad_source_family_mismatch"),
        ([record("a", source_version="2")], "ad_source_version_mismatch"),
        ([record("a"), record("a")], "ad_duplicate_record_identity"),
        ([record("a", revises="z")], "ad_revision_target_missing"),
        ([record("a", reverses="z")], "ad_reversal_target_missing"),
        ([record("a"), record("b", revises="a", currency="EUR")], "ad_linkage_family_mismatch"),
        ([record("a"), record("b", reverses="a", entity_id="f")], "ad_linkage_family_mismatch"),
        ([record("a", seen=5), record("b", revises="a")], "ad_non_monotonic_history"),
        ([record("a"), record("c"), record("b", revises="a", reverses="c")], "ad_non_monotonic_history"),
        ([record("a", revises="b"), record("b", revises="a")], "ad_non_monotonic_history"),
        ([record("a", revises="c"), record("b", reverses="a"), record("c", revises="b"), record("d", revises="c")], "ad_non_monotonic_history"),
        ([record("a"), record("b", revises="a", seen=3), record("c", revises="a", seen=3)], "ad_non_monotonic_history"),
    ],
)
def test_faults_raise_their_code(frames, rows, code):
    with pytest.raises(ValueError, match=code):
        chosen(frames, rows)


def test_one_version_a_root(frames):
    rows = [record("a"), record("b", revises="a", seen=2), record("c", revises="b", seen=3, status="pending"), record("d", revises="a", seen=4), record("e", day=19), record("f", day=20), record("a", source="t"), record("g", reverses="e", day=19, seen=1.4)]
    # c is not eligible and replaces nothing; f ends after the decision's hour; d is later than b
    assert chosen(frames, rows) == {("s", "d", "a"), ("s", "e", "e"), ("t", "a", "a"), ("s", "g", "g")}
    assert chosen(frames, []) == set()


def test_roots_of_long_chains_and_a_hub(frames):
    rng = random.Random(3)
    parent = {i: i - 1 for i in range(1, 70)} | {i: 5 for i in range(100, 180)} | {i: rng.choice(range(200, i)) for i in range(201, 260)}
    rows = [record(str(i), seen=i / 100, revises=str(parent[i]) if i in parent else None) for i in [*range(70), *range(100, 180), *range(200, 260)]]
    rows += [record("p", revises="q", seen=1), record("q", revises="p", seen=1), record("r", revises="p", seen=2)]
    records, _ = frames(rows)
    got = {r.record_id: (r.root, r.depth, r.cyclic) for r in lineage.revision_roots(records).collect()}

    def walk(i):
        depth = 0
        while i in parent:
            i, depth = parent[i], depth + 1
        return str(i), depth, False

    assert got == {r[2]: walk(int(r[2])) for r in rows[:-3]} | dict.fromkeys("pqr", (None, None, True))


def test_fault_order_counts_each_record_once(frames):
    got = lineage.link_faults(*frames([record("a", source="x", revises="z"), record("b", revises="z", reverses="y"), record("c")])).collect()
    assert {(r.record_id, r.code) for r in got} == {("a", "ad_source_not_declared"), ("b", "ad_revision_target_missing")}


def test_only_links_of_equal_times_are_searched_for_cycles(frames):
    rows = [record("a"), record("b", 2, revises="a"), record("c", 2, reverses="b")]
    found = lineage.level_links(frames(rows)[0]).collect()
    assert [(r.record_id, r.parent) for r in found] == [("c", "b")]
    # a record without a time may stand between later and earlier ones
    rows = [record("a", 3, revises="b"), record("b", 2, revises="c"), record("c", revises="a", observed_at=None)]
    assert {r.record_id for r in lineage.level_links(frames(rows)[0]).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="ad_non_monotonic_history"):
        chosen(frames, rows)
