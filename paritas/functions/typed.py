"""Typed labels at plan time: a label of another type than its column matches nothing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas.config import Label


def fits(dtype: T.DataType, label: Label) -> bool:
    if isinstance(label, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(label, int):
        return isinstance(dtype, T.IntegralType)
    return isinstance(label, str) and isinstance(dtype, T.StringType)


def is_label(df: DataFrame, column: str, label: Label) -> Column:
    if not fits(df.schema[column].dataType, label):
        return F.lit(False)
    return F.coalesce(F.col(column) == F.lit(label), F.lit(False))


def is_one_of(df: DataFrame, column: str, labels) -> Column:
    own = [x for x in labels if fits(df.schema[column].dataType, x)]
    return F.coalesce(F.col(column).isin(own), F.lit(False)) if own else F.lit(False)


def missing(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def token(label: Label) -> str:
    """Type tag and hex of the label's JSON."""
    kind = type(label).__name__
    return f"{kind}-{json.dumps(label, ensure_ascii=False).encode().hex()}"


def metric_key(metric: str, attribute: str | None = None, value: Label | None = None, reference: Label | None = None) -> str:
    if attribute is None:
        return f"overall.{metric}"
    if reference is None:
        return f"group.{token(attribute)}.{token(value)}.{metric}"
    return f"comparison.{token(attribute)}.{token(value)}.vs.{token(reference)}.{metric}"
