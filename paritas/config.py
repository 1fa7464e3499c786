"""The audit contract: roles of columns, labels, policies. Declared, never inferred."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields

Label = str | int | bool

POLICIES = ("error", "exclude", "allow")


def same(a: Label, b: Label) -> bool:
    """Type-sensitive equality: 1, True and "1" are three labels."""
    return type(a) is type(b) and a == b


def contains(labels, x: Label) -> bool:
    return any(same(x, y) for y in labels)


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class AuditConfig:
    outcome: str
    score: str
    favorable_outcome: Label
    protected: tuple[str, ...]
    reference: dict[str, Label]
    allowed: dict[str, tuple[Label, ...]]
    decision: str | None = None
    favorable_decision: Label | None = None
    threshold: float | None = None
    operator: str | None = None
    score_direction: str = "higher"
    score_type: str = "probability"
    weight: str | None = None
    record_id: str | None = None
    candidate_proxies: tuple[str, ...] = ()
    expected_categories: dict[str, tuple[Label, ...]] = field(default_factory=dict)
    minimum_group_size: int = 30
    confidence_level: float = 0.95
    seed: int = 0
    resamples: int = 1000
    minimum_valid_resamples: int = 800
    air_threshold: float = 0.8
    missing_policy: str = "error"
    unknown_group_policy: str = "error"
    duplicate_policy: str = "error"
    dataset_version: str | None = None
    model_version: str | None = None
    population_definition: str | None = None
    sampling_definition: str | None = None
    #: Prefix of the bootstrap stream; pass another system's prefix to reproduce its draws.
    stream_domain: str = "audit-bootstrap-v1\0"

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ConfigError(what)

        need(bool(self.protected), "at least one protected attribute is needed")
        need(0 < self.minimum_valid_resamples <= self.resamples, "minimum_valid_resamples must be within resamples")
        need(math.isfinite(self.air_threshold), "air_threshold must be finite")
        need(0 < self.confidence_level < 1, "confidence_level must be within (0, 1)")
        need(0 <= self.seed < 2**64, "seed must fit 64 bits")
        need(set(self.protected) == set(self.reference) == set(self.allowed), "protected, reference and allowed must name the same attributes")
        for a in self.protected:
            labels = self.allowed[a]
            need(bool(labels), f"{a} allows no group")
            need(not any(same(x, y) for i, x in enumerate(labels) for y in labels[i + 1 :]), f"{a} repeats a group")
            need(contains(labels, self.reference[a]), f"the reference of {a} is not allowed")
        observed, derived = self.decision is not None, self.threshold is not None or self.operator is not None
        need(observed != derived, "give either an observed decision or a threshold with an operator")
        if observed:
            need(self.favorable_decision is not None, "an observed decision needs its favorable label")
        else:
            need(self.threshold is not None and self.operator is not None, "threshold and operator go together")
            need(math.isfinite(self.threshold), "threshold must be finite")
            need(self.operator == {"higher": "ge", "lower": "le"}[self.score_direction], "operator does not match the score's direction")
        roles = [self.outcome, self.score, *self.protected, *self.candidate_proxies, *[c for c in (self.decision, self.weight, self.record_id) if c]]
        need(len(roles) == len(set(roles)), "a column has more than one role")
        need(set(self.expected_categories) <= {self.outcome, self.decision, *self.protected}, "expected_categories name outcome, decision or protected columns")
        for column, labels in self.expected_categories.items():
            must = self.favorable_outcome if column == self.outcome else self.favorable_decision if column == self.decision else self.reference[column]
            need(contains(labels, must), f"expected_categories of {column} miss its favorable or reference value")
        for p in (self.missing_policy, self.unknown_group_policy, self.duplicate_policy):
            need(p in POLICIES, f"unknown policy {p}")
        for p in (self.missing_policy, self.unknown_group_policy):
            need(p != "allow", "rows with missing values or unknown groups cannot be allowed")

    @property
    def required(self) -> tuple[str, ...]:
        extra = (self.decision, self.weight, self.record_id)
        return (self.outcome, self.score, *[c for c in extra if c], *self.protected, *self.candidate_proxies)


def from_json(text: str) -> AuditConfig:
    raw = json.loads(text)
    known = {f.name for f in fields(AuditConfig)}
    if unknown := set(raw) - known:
        raise ConfigError(f"unknown fields: {sorted(unknown)}")
    for k in ("protected", "candidate_proxies"):
        if k in raw:
            raw[k] = tuple(raw[k])
    for k in ("allowed", "expected_categories"):
        if k in raw:
            raw[k] = {a: tuple(v) for a, v in raw[k].items()}
    return AuditConfig(**raw)
