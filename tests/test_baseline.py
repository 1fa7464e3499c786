"""Baseline comparison on small frames."""

import pytest

from paritas.config import AuditConfig
from paritas.operators import baseline, validate

BASE = {"outcome": "outcome", "score": "score", "favorable_outcome": 1, "protected": ("group",), "reference": {"group": "A"}, "allowed": {"group": ("A", "B", "C")}, "threshold": 1.0, "operator": "ge", "score_type": "ranking", "dataset_version": "data-v1", "missing_policy": "exclude", "duplicate_policy": "allow"}
POLICY = baseline.Policy(group=0.25, missing=0.1, score=1.0, outcome=0.25)
ROWS = {False: [(1, 0.0, "A"), (0, 1.0, "A"), (1, 2.0, "B"), (0, 3.0, "B")], True: [(1, 1.0, "A"), (1, 2.0, "B"), (1, 3.0, "B"), (0, 4.0, "B")]}


def made(spark, rows=ROWS[False], **kw):
    config = AuditConfig(**(BASE | kw))
    return baseline.profile(validate.flag_rows(spark.createDataFrame(rows, "outcome long, score double, group string"), config), config)


def test_no_baseline_has_the_manifest_of_the_current_run(spark):
    r = baseline.compare(made(spark), None, "b", None, POLICY)
    assert (r["status"], len(r["checks"]), r["flags"]) == ("unavailable", 26, [])
    assert {c["status"] for c in r["checks"]} == {"unavailable"} and {c["reason_code"] for c in r["checks"]} == {"baseline_unavailable"}
    assert r["issues"] == [{"code": "comparison_baseline_unavailable", "sources": [c["check_id"] for c in r["checks"]]}]
    assert len({c["check_id"] for c in r["checks"]}) == 26


def test_changes_at_the_threshold_are_flagged(spark):
    current, base = made(spark, ROWS[True], dataset_version="data-v2"), made(spark)
    r = baseline.compare(current, base, "b", base.digest, POLICY)
    assert r["status"] == "partially_completed" and "zero_group_sample" in {c["reason_code"] for c in r["checks"]} and "version_unavailable" in {c["reason_code"] for c in r["checks"]}
    assert {f["code"] for f in r["flags"]} == {"group_composition_changed", "score_distribution_changed", "outcome_distribution_changed", "dataset_version_changed"}
    by_id = {c["check_id"]: c for c in r["checks"]}
    assert all(f[k] == by_id[f["source_check_id"]][k] for f in r["flags"] for k in ("statistic", "threshold", "current_value", "baseline_value"))
    assert [i["code"] for i in r["issues"]] == ["comparison_check_not_computable", *sorted({f["code"] for f in r["flags"]})]
    same = baseline.compare(base, base, "b", base.digest, POLICY)
    assert same["flags"] == [] and [c["check_id"] for c in same["checks"]] == [c["check_id"] for c in r["checks"]]


def test_categories_come_and_go(spark):
    current, base = made(spark, [(1, 0.0, "A"), (2, 1.0, "B")]), made(spark)
    r = baseline.compare(current, base, "b", base.digest, POLICY)
    assert {"outcome_category_added", "outcome_category_removed"} <= {f["code"] for f in r["flags"]}


@pytest.mark.parametrize(
    "change,reason",
    [
        ({"score_direction": "lower", "operator": "le"}, "analysis_semantics_mismatch"), ({"favorable_outcome": 0}, "analysis_semantics_mismatch"), ({"allowed": {"group": ("A", "B")}}, "group_definition_mismatch"),
        ({"reference": {"group": "B"}}, "group_definition_mismatch"), ({"population_definition": "declined"}, "profile_method_mismatch"), ({"sampling_definition": "random"}, "profile_method_mismatch"),
    ],
)
def test_incompatible_profiles_are_not_compared(spark, change, reason):
    current, base = made(spark), made(spark, **change)
    r = baseline.compare(current, base, "b", base.digest, POLICY)
    assert r["status"] == "incompatible" and {c["reason_code"] for c in r["checks"]} == {reason} and r["flags"] == []
    assert {c["current_value"] for c in r["checks"]} == {None}


def test_digest_and_attachment(spark):
    base, other = made(spark), made(spark, ROWS[True])
    assert base.digest == made(spark, ROWS[False][::-1]).digest != other.digest
    assert {c["reason_code"] for c in baseline.compare(other, base, "b", "0" * 64, POLICY)["checks"]} == {"baseline_digest_mismatch"}
    r = baseline.compare(base, base, "b", base.digest, POLICY)
    attached = baseline.attach({"metrics": []}, base, r)
    assert attached["comparison"] == r
    with pytest.raises(ValueError, match="already"):
        baseline.attach(attached, base, r)
    with pytest.raises(ValueError, match="another profile"):
        baseline.attach({}, other, r)
    with pytest.raises(ValueError):
        baseline.Policy(group=True, missing=0.1, score=0.1, outcome=0.1)
