"""Validation: reason flags, one counting pass, policies, eligible rows, exclusion evidence."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.config import AuditConfig
from paritas.functions import typed

REASONS = ("missing_required_value", "unknown_protected_group", "duplicate_record", "non_finite_numeric", "unexpected_category")


class AuditDataError(ValueError):
    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code} {detail}".strip())
        self.code = code


def check_columns(df: DataFrame, config: AuditConfig) -> None:
    if absent := [c for c in config.required if c not in df.columns]:
        raise AuditDataError("missing_required_column", ", ".join(absent))
    for c in (config.score, *([config.weight] if config.weight else [])):
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise AuditDataError("non_numeric_column", c)


def _any(columns: list[Column]) -> Column:
    return reduce(or_, columns) if columns else F.lit(False)


def missing_flag(df: DataFrame, columns) -> Column:
    return _any([typed.missing(df, c) for c in columns])


def with_duplicates(df: DataFrame, record_id: str | None, name: str) -> DataFrame:
    """``df`` with a flag on every member of a group of equal ids (or of equal rows); ids that are null are not flagged.

    Ids alone are counted, with partial counts, and the ids that repeat are joined back: whole rows are not grouped by id.
    """
    if not record_id:
        return df.withColumn(name, F.count("*").over(Window.partitionBy(*df.columns)) > 1)
    twice = df.filter(F.col(record_id).isNotNull()).groupBy(F.col(record_id).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__id")
    return df.join(twice, F.col(record_id) == F.col("__id"), "left").withColumn(name, F.col("__id").isNotNull()).drop("__id")


def nonfinite_flag(columns) -> Column:
    return _any([F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False)) for c in columns])


def outside_flag(df: DataFrame, column: str, labels) -> Column:
    return ~typed.missing(df, column) & ~typed.is_one_of(df, column, labels)


def flag_rows(df: DataFrame, config: AuditConfig) -> DataFrame:
    """``df`` with one boolean column per reason and ``__excluded`` by policy."""
    check_columns(df, config)
    flags = {
        "missing_required_value": missing_flag(df, config.required),
        "unknown_protected_group": _any([outside_flag(df, a, config.allowed[a]) for a in config.protected]),
        "non_finite_numeric": nonfinite_flag([c for c in (config.score, config.weight) if c]),
        "unexpected_category": _any([outside_flag(df, c, v) for c, v in config.expected_categories.items()]),
    }
    counted = [*flags, "duplicate_record"] if config.duplicate_policy != "allow" else list(flags)
    flagged = with_duplicates(df, config.record_id, "duplicate_record").withColumns(flags)
    return flagged.select(*df.columns, *REASONS).withColumn("__excluded", _any([F.col(r) for r in counted]))


def reason_counts(flagged: DataFrame) -> DataFrame:
    """One pass: rows, rows by reason (a row counts once for each) and excluded rows."""
    counts = [F.coalesce(F.sum(F.col(r).cast("long")), F.lit(0)).alias(r) for r in REASONS]
    return flagged.agg(F.count("*").alias("input_rows"), *counts, F.coalesce(F.sum(F.col("__excluded").cast("long")), F.lit(0)).alias("excluded_rows"))


def exclusion_evidence(flagged: DataFrame, config: AuditConfig) -> DataFrame:
    """(reason, attribute, value, rows) for unknown groups and missing required columns."""
    cases = [F.when(outside_flag(flagged, a, config.allowed[a]), F.struct(F.lit("unknown_protected_group").alias("reason"), F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))) for a in config.protected]
    cases += [F.when(typed.missing(flagged, c), F.struct(F.lit("missing_required_value").alias("reason"), F.lit(c).alias("attribute"), F.lit(None).cast("string").alias("value"))) for c in config.required]
    found = flagged.select(F.explode(F.array_compact(F.array(*cases))).alias("e")).select("e.*")
    return found.groupBy("reason", "attribute", "value").agg(F.count("*").alias("rows"))


def exclusion_projection(counts: DataFrame) -> DataFrame:
    """(reason, rows) from the row of ``reason_counts``: excluded rows dealt to reasons by name, each up to its hits.

    A row that several reasons hit is so attributed once. A reason that a policy allows takes its share
    all the same; reasons that get none have no row.
    """
    names, before = sorted(REASONS), F.lit(0).cast("long")
    dealt = []
    for name in names:
        upto = before + F.col(name)
        rows = F.least(upto, "excluded_rows") - F.least(before, "excluded_rows")
        dealt.append(F.struct(F.lit(name).alias("reason"), rows.alias("rows")))
        before = upto
    return counts.select(F.explode(F.array(*dealt)).alias("x")).select("x.reason", "x.rows").filter("rows > 0")


def small_groups(rows: DataFrame, protected: list[str] | tuple[str, ...], minimum: int) -> DataFrame:
    """(attribute, value, rows) of the observed groups with fewer than ``minimum`` eligible rows, in one pass."""
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in protected])
    found = rows.select(F.explode(cells).alias("x")).groupBy("x.attribute", "x.value").agg(F.count("*").alias("rows"))
    return found.filter(F.col("value").isNotNull() & (F.col("rows") < minimum))


def eligible(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("__excluded")).drop(*REASONS, "__excluded")


def validate(df: DataFrame, config: AuditConfig) -> tuple[DataFrame, dict]:
    """Eligible rows and counts; raises where a policy says error or a semantic check fails."""
    flagged = flag_rows(df, config)
    counts = reason_counts(flagged).first().asDict()
    if not counts["input_rows"]:
        raise AuditDataError("no_eligible_rows")
    policy = {"missing_required_value": config.missing_policy, "unknown_protected_group": config.unknown_group_policy, "duplicate_record": config.duplicate_policy, "non_finite_numeric": "error", "unexpected_category": "error"}
    for reason, p in policy.items():
        if counts[reason] and p == "error":
            raise AuditDataError(reason, f"{counts[reason]} rows")
    rows = eligible(flagged)
    checks = {"favorable_outcome_absent": typed.is_label(rows, config.outcome, config.favorable_outcome)}
    if config.decision:
        checks["favorable_decision_absent"] = typed.is_label(rows, config.decision, config.favorable_decision)
    for a in config.protected:
        checks[f"reference_group_absent:{a}"] = typed.is_label(rows, a, config.reference[a])
    aggs = [F.max(c).alias(k.replace(":", "__")) for k, c in checks.items()] + [F.count("*").alias("n")]
    if config.weight:
        aggs += [F.min(config.weight).alias("low"), F.sum(config.weight).alias("total")]
    if config.score_type == "probability":
        aggs += [F.min(F.col(config.score).cast("double")).alias("least"), F.max(F.col(config.score).cast("double")).alias("most")]
    got = rows.agg(*aggs).first().asDict()
    if not got["n"]:
        raise AuditDataError("no_eligible_rows")
    for k in checks:
        if not got[k.replace(":", "__")]:
            raise AuditDataError(k)
    if config.score_type == "probability" and not 0 <= got["least"] <= got["most"] <= 1:
        raise AuditDataError("invalid_probability")
    if config.weight and (got["low"] < 0 or got["total"] <= 0):
        raise AuditDataError("invalid_weights")
    return rows, counts | {"eligible_rows": got["n"]}


def normalize(rows: DataFrame, config: AuditConfig) -> DataFrame:
    """(protected..., y, d, s, w): favorable outcome and decision as booleans, oriented score, weight."""
    score = F.col(config.score).cast("double")
    if config.decision:
        d = typed.is_label(rows, config.decision, config.favorable_decision)
    else:
        d = score >= config.threshold if config.operator == "ge" else score <= config.threshold
    s = score if config.score_direction == "higher" else 1 - score
    w = F.col(config.weight).cast("double") if config.weight else F.lit(1.0)
    extra = [F.col(config.record_id).alias("record_id")] if config.record_id else []
    return rows.select(*extra, *config.protected, typed.is_label(rows, config.outcome, config.favorable_outcome).alias("y"), d.alias("d"), s.alias("s"), w.alias("w"))
