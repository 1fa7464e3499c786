"""Config, validation, metrics, reliability, reports and the command line."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from paritas import cli
from paritas.audit import run_audit
from paritas.config import AuditConfig, ConfigError, from_json
from paritas.functions import typed
from paritas.operators import metrics, profile, validate
from paritas.operators.validate import AuditDataError
from paritas.sources import files

BASE = {"outcome": "y", "score": "s", "favorable_outcome": 1, "protected": ("g",), "reference": {"g": "A"}, "allowed": {"g": ("A", "B", "C")}, "decision": "d", "favorable_decision": 1, "minimum_group_size": 1, "resamples": 20, "minimum_valid_resamples": 10}


def config(**kw):
    return AuditConfig(**(BASE | kw))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("r1", 1, 0.9, 1, "A"), ("r2", 1, 0.8, 0, "A"), ("r3", 0, 0.4, 1, "A"), ("r4", 0, 0.1, 0, "A"), ("r5", 1, 0.7, 1, "B"), ("r6", 1, 0.6, 0, "B"), ("r7", 0, 0.5, 0, "B"), ("r8", 0, 0.2, 0, "B")]
    return spark.createDataFrame(rows, "id string, y long, s double, d long, g string")


@pytest.mark.parametrize(
    "change",
    [
        {"protected": ()}, {"minimum_valid_resamples": 30}, {"air_threshold": float("inf")}, {"reference": {"g": "Z"}}, {"allowed": {"g": ("A", "A")}}, {"decision": None, "favorable_decision": None},
        {"threshold": 0.5, "operator": "ge"}, {"decision": None, "threshold": 0.5, "operator": "le"}, {"weight": "s"}, {"expected_categories": {"y": (0,)}}, {"expected_categories": {"zz": (0,)}}, {"missing_policy": "maybe"}, {"missing_policy": "allow"}, {"unknown_group_policy": "allow"}, {"reference": {"h": "A"}},
    ],
)
def test_config_rules(change):
    with pytest.raises(ConfigError):
        config(**change)


def test_labels_are_typed(spark, frame):
    assert from_json(json.dumps(BASE)) == config()
    with pytest.raises(ConfigError):
        from_json('{"unknown": 1}')
    config(allowed={"g": ("A", 1, True)})  # three labels
    assert frame.filter(typed.is_label(frame, "y", "1")).count() == 0 == frame.filter(typed.is_label(frame, "y", True)).count()
    assert typed.token("B") == "str-224222"
    assert typed.metric_key("precision", "g", "B").startswith("group.str-226722.str-224222")


def test_validation_reasons(spark, frame):
    odd = spark.createDataFrame([("r1", 1, float("nan"), 1, "A"), ("x1", 1, float("inf"), 1, "A"), ("x2", 1, 0.5, 1, "Z"), (None, 1, 0.5, 1, "B")], frame.schema)
    c = config(record_id="id", missing_policy="exclude", unknown_group_policy="exclude", duplicate_policy="exclude")
    got = validate.reason_counts(validate.flag_rows(frame.union(odd), c)).first().asDict()
    assert got == {"input_rows": 12, "missing_required_value": 2, "unknown_protected_group": 1, "duplicate_record": 2, "non_finite_numeric": 1, "unexpected_category": 0, "excluded_rows": 5}
    with pytest.raises(AuditDataError, match="non_finite"):
        validate.validate(frame.union(odd), c)
    with pytest.raises(AuditDataError, match="missing_required_column"):
        validate.validate(frame.drop("s"), c)
    with pytest.raises(AuditDataError, match="favorable_outcome_absent"):
        validate.validate(frame, config(favorable_outcome="1"))
    with pytest.raises(AuditDataError, match="no_eligible_rows"):
        validate.validate(frame.limit(0), config())
    with pytest.raises(AuditDataError, match="reference_group_absent"):
        validate.validate(frame, config(reference={"g": "C"}))


def test_metrics_by_hand(frame):
    r = run_audit(frame, config())
    m = {x["metric_key"]: x for x in r["metrics"]}
    at = lambda name, v=None: m[typed.metric_key(name, "g", v) if v else typed.metric_key(name)]
    assert at("selection_rate")["value"] == 3 / 8 and at("selection_rate", "A")["value"] == 0.5 and at("selection_rate", "B")["value"] == 0.25
    assert at("true_positive_rate", "A")["value"] == 0.5 and at("false_positive_rate", "A")["value"] == 0.5 and at("precision", "B")["value"] == 1.0
    assert at("roc_auc", "A")["value"] == 1.0 and at("roc_auc")["value"] == 1.0
    assert at("brier_score", "A")["value"] == pytest.approx((0.01 + 0.04 + 0.16 + 0.01) / 4)
    assert at("selection_rate", "C") | {} == at("selection_rate", "C") and at("selection_rate", "C")["undefined_reason"] == "empty_population"
    cmp_ = {x["metric"]: x for x in r["metrics"] if x.get("comparison_group") == {"g": "B"}}
    assert cmp_["adverse_impact_ratio"]["value"] == 0.5 and cmp_["selection_rate_difference"]["value"] == -0.25 == cmp_["demographic_parity_difference"]["value"]
    assert cmp_["equal_opportunity_difference"]["value"] == 0 and cmp_["equalized_odds_gap"]["value"] == 0.5
    assert [f["value"] for f in r["flags"]] == ["B"]
    assert [x["metric"] for x in r["metrics"][:9]] == list(metrics.SCOPE_METRICS)


def test_weights_and_orientation(spark, frame):
    w = frame.withColumn("w", validate.F.when(validate.F.col("d") == 1, 1).otherwise(3))
    m = {x["metric_key"]: x["value"] for x in run_audit(w, config(weight="w"))["metrics"]}
    assert m[typed.metric_key("selection_rate", "g", "A")] == 0.25
    low = config(score_direction="lower", decision=None, favorable_decision=None, threshold=0.5, operator="le")
    got = validate.normalize(frame, low).select("d", "s").collect()
    assert [r.d for r in got].count(True) == 4 and got[0].s == pytest.approx(0.1)


def test_gates(frame):
    r = run_audit(frame, config(minimum_group_size=3))
    codes = {x["metric_key"]: x["limitations"] for x in r["metrics"] if "limitations" in x}
    assert codes[typed.metric_key("selection_rate", "g", "A")] == []
    assert codes[typed.metric_key("precision", "g", "A")] == ["severe_outcome_imbalance", "sparse_decision_support"]
    assert codes[typed.metric_key("precision", "g", "C")] == []
    assert run_audit(frame, config(minimum_group_size=5))["flags"] == []


def test_intervals_are_reproducible(frame):
    a, b = (run_audit(frame.repartition(n), config(record_id="id", seed=3), intervals=True)["metrics"] for n in (1, 3))
    assert a == b and any("interval_lower" in x for x in a)


def test_profile_and_drift(spark):
    df = spark.createDataFrame([(0.0, 1, "A"), (1.0, 0, "A"), (2.0, 1, "B"), (10.0, 0, "B")], "s double, y int, g string")
    assert profile.distribution(df, "s").first().quantiles == [0.0, 0.75, 1.5, 4.0, 10.0]
    o = profile.outliers(df, "s").first()
    assert (o.upper_fence, o.below, o.above) == (8.875, 0, 1)
    edge = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (5.0,)], "s double")
    assert profile.outliers(edge, "s").first().above == 0  # strict
    f = profile.facets(df, "s", "y", "g", ["s"])
    moved = profile.facets(df.withColumn("s", validate.F.col("s") + 1), "s", "y", "g", ["s"])
    got = profile.drift(moved, f, {"group_proportion": 0.25, "missingness_rate": 0.1, "score_quantile": 1.0, "outcome_proportion": 0.25}).collect()
    assert {r.code for r in got if r.status == "changed"} == {"score_quantile"}  # inclusive limit


def test_command_line_and_artifacts(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("id,y,s,d,g\n" + "".join(f"r{i},{i % 2},0.{i},{int(i > 4)},{'AB'[i % 2]}\n" for i in range(1, 9)) + "r9,NA,0.5,1,A\n")
    (tmp_path / "c.json").write_text(json.dumps(BASE | {"missing_policy": "exclude"}))
    argv = ["audit", "--data", str(tmp_path / "d.csv"), "--schema", "id string, y long, s double, d long, g string", "--config", str(tmp_path / "c.json"), "--output", str(tmp_path / "o"), "--format", "json", "--format", "csv", "--format", "html"]
    assert cli.main(argv) == cli.OK
    assert cli.main(argv) == cli.OUTPUT and cli.main([*argv, "--overwrite"]) == cli.OK
    result = json.loads((tmp_path / "o/audit-result.json").read_text())
    assert result["validation"]["excluded_rows"] == 1
    text = (tmp_path / "o/metrics.csv").read_bytes().decode()
    assert text.count("\r\n") == len(result["metrics"]) + 1 and tuple(next(csv.reader(io.StringIO(text)))) == files.METRIC_COLUMNS
    assert "<script" not in (tmp_path / "o/report.html").read_text()
    assert cli.main(["audit"]) == cli.USAGE
    (tmp_path / "c.json").write_text("{}")
    assert cli.main(argv) == cli.CONFIG
    capsys.readouterr()


def test_publish_is_all_or_nothing(tmp_path):
    files.publish({"a": "1", "b": "2"}, tmp_path)
    (tmp_path / "l").symlink_to(tmp_path / "a")
    with pytest.raises(OSError):
        files.publish({"a": "9", "l": "9"}, tmp_path, True)
    assert (tmp_path / "a").read_text() == "1"


def test_field_map(spark):
    df = spark.createDataFrame([("x", "1.50"), ("y", "1e400")], "acct string, amt string")
    out = files.map_fields(df, {"acct": "entity_id", "amt": "amount"}, {"family": "rent"}, ["entity_id", "amount", "family"])
    assert out.columns == ["entity_id", "amount", "family"]
    assert [None if r[0] is None else float(r[0]) for r in out.select(files.decimal_text("amount")).collect()] == [1.5, None]
    with pytest.raises(ValueError):
        files.map_fields(df, {"acct": "entity_id"}, {}, ["entity_id", "amount"])


def test_contracts(spark, frame):
    from paritas.operators import registry

    rows = validate.normalize(frame, config())
    long = metrics.scope_metrics(metrics.scope_stats(rows, {"g": ["A", "B", "C"]}), True, metrics.scope_auc(rows, ["g"]))
    assert registry.out_of_range(long).count() == 0
    assert {r.reason for r in long.select("reason").distinct().collect()} <= {None, *registry.UNDEFINED}
    assert registry.has_verdict("The lender is not compliant") and not registry.has_verdict("ratio below the screening threshold")
    new = registry.migrate({"schema_version": "1.0", "metrics": [{"value": 1}], "limitations": [{"code": "x"}]})
    assert new["schema_version"] == "2.0" and new["metrics"][0]["reliability"] == "not_assessed"
    with pytest.raises(ValueError):
        registry.migrate(new)


def test_labels_with_quotes_and_reasons_of_differences(frame):
    rows = frame.withColumn("g", F.when(F.col("g") == "A", "O'Neil").otherwise(F.col("g")))
    result = run_audit(rows, config(reference={"g": "O'Neil"}, allowed={"g": ("O'Neil", "B", "C")}))
    compared = {(m["metric"], m["comparison_group"]["g"]): (m["value"], m["undefined_reason"]) for m in result["metrics"] if "comparison_group" in m}
    assert compared["selection_rate_difference", "B"] == (-0.25, None)
    for m, why in {"selection_rate_difference": "comparison_metric_undefined", "demographic_parity_difference": "comparison_metric_undefined", "equal_opportunity_difference": "comparison_metric_undefined", "equalized_odds_gap": "component_metric_undefined"}.items():
        assert compared[m, "C"] == (None, why)


def test_probabilities_lie_between_zero_and_one(frame):
    with pytest.raises(AuditDataError, match="invalid_probability"):
        run_audit(frame.withColumn("s", F.col("s") * 4), config())


def test_excluded_rows_are_dealt_once(spark):
    row = dict.fromkeys(validate.REASONS, 0) | {"input_rows": 20, "excluded_rows": 7, "duplicate_record": 4, "non_finite_numeric": 2, "unknown_protected_group": 5}
    got = validate.exclusion_projection(spark.createDataFrame([row])).collect()
    assert {r.reason: r.rows for r in got} == {"duplicate_record": 4, "non_finite_numeric": 2, "unknown_protected_group": 1}


def test_small_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 2)], "g string, h int")
    assert {tuple(r) for r in validate.small_groups(df, ["g", "h"], 2).collect()} == {("g", "b", 1), ("h", "2", 1)}


def test_weights_of_the_largest(spark):
    from paritas.operators import risk

    df = spark.createDataFrame([(1, 4.0), (2, 1.0), (3, 0.0)], "id int, w double")
    assert [r.w for r in risk.normalized_weights(df).orderBy("id").collect()] == [1.0, 0.25, 0.0]
    assert [r.w for r in risk.normalized_weights(df.filter("w = 0")).collect()] == [0.0]
