"""Sources and sinks: CSV with an explicit schema, field maps, verified archives, JSON/CSV/HTML reports."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens read as missing, beside the empty cell.
NA_TOKENS = ("NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>")

#: Columns of the metrics table, in order.
METRIC_COLUMNS = ("metric_key", "metric", "value", "undefined_reason", "reliability", "sample_count", "group", "comparison_group", "reference_group", "interval_lower", "interval_upper", "confidence_level")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header; cells that hold a missing token become null. Types are declared."""
    want = spark.createDataFrame([], schema).schema
    text = spark.read.csv(path, header=True, encoding="utf-8")
    if absent := [f.name for f in want if f.name not in text.columns]:
        raise ValueError(f"missing columns: {absent}")
    cells = [F.when(~F.trim(f"`{f.name}`").isin(*NA_TOKENS, ""), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in want]
    return text.select(*cells)


def map_fields(df: DataFrame, mapping: dict[str, str], constants: dict[str, str], canonical: list[str]) -> DataFrame:
    """Rows of another system under canonical names; the mapped and constant names must be exactly those."""
    if sorted([*mapping.values(), *constants]) != sorted(canonical):
        raise ValueError("ad_mapping_mismatch")
    if absent := [c for c in mapping if c not in df.columns]:
        raise ValueError(f"ad_missing_field {absent}")
    named = {v: F.col(f"`{k}`") for k, v in mapping.items()} | {k: F.lit(v) for k, v in constants.items()}
    return df.select(*[named[c].alias(c) for c in canonical])


def decimal_text(column: str):
    """A decimal given as text; anything but a plain finite number is null."""
    c = F.col(column)
    return F.when(c.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.expr(f"try_cast(`{column}` AS DECIMAL(38,18))"))


def fixed_table(spark: SparkSession, path: str, sha256: str, names: list[str]) -> DataFrame:
    """A white-space table of integers whose bytes are verified first."""
    one = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), F.decode("content", "UTF-8").alias("t"))
    if [r.h for r in one.select("h").collect()] != [sha256]:
        raise ValueError("source digest mismatch")
    rows = one.select(F.explode(F.split("t", r"\r?\n")).alias("line")).filter(F.trim("line") != "")
    cells = F.split(F.trim("line"), r"\s+")
    return rows.select(*[F.expr(f"try_cast(split(trim(line), '\\\\s+')[{i}] AS BIGINT)").alias(n) for i, n in enumerate(names)]) if names else rows.select(cells.alias("cells"))


def metrics_csv(rows: list[dict]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(METRIC_COLUMNS)
    for r in rows:
        w.writerow(["" if r.get(c) is None else json.dumps(r[c], sort_keys=True) if isinstance(r[c], dict) else r[c] for c in METRIC_COLUMNS])
    return out.getvalue()


def report_json(result: dict) -> str:
    return json.dumps(result, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def report_html(result: dict) -> str:
    """A page without scripts: run, validation, metrics, flags, limitations."""
    e = lambda x: html.escape("" if x is None else str(x))
    head = "".join(f"<th>{e(c)}</th>" for c in METRIC_COLUMNS)
    body = "".join("<tr>" + "".join(f"<td>{e(json.dumps(r[c]) if isinstance(r.get(c), dict) else r.get(c))}</td>" for c in METRIC_COLUMNS) + "</tr>" for r in result["metrics"])
    flags = "".join(f"<li>{e(f['attribute'])} = {e(f['value'])}: ratio {e(f['adverse_impact_ratio'])} against {e(f['reference'])}</li>" for f in result["flags"])
    counts = "".join(f"<li>{e(k)}: {e(v)}</li>" for k, v in result["validation"].items())
    note = "Statistical screening evidence for human review; not a legal conclusion."
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Audit</title></head><body><h1>Audit</h1><p>{note}</p><h2>Validation</h2><ul>{counts}</ul><h2>Flags</h2><ul>{flags}</ul><h2>Metrics</h2><table><tr>{head}</tr>{body}</table></body></html>\n'


@dataclass(frozen=True)
class Sink:
    """A form of the report: its file, and how a result becomes its text."""

    file: str
    text: Callable[[dict], str]


#: The files' names.
SINKS = {
    "json": Sink("audit-result.json", report_json),
    "csv": Sink("metrics.csv", lambda result: metrics_csv(result["metrics"])),
    "html": Sink("report.html", report_html),
}


def publish(files: dict[str, str], folder: str, overwrite: bool = False) -> None:
    """All files or none: written aside, synced, renamed; what was replaced comes back on failure."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    targets = {name: root / name for name in files}
    for t in targets.values():
        if t.is_symlink():
            raise OSError(f"{t} is a symbolic link")
        if t.exists() and not overwrite:
            raise FileExistsError(str(t))
    with tempfile.TemporaryDirectory(dir=root) as aside:
        for name, text in files.items():
            with open(os.path.join(aside, name), "w", encoding="utf-8", newline="") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        kept, done = {}, []
        try:
            for name, t in targets.items():
                if t.exists():
                    kept[name] = Path(aside) / f"{name}.before"
                    os.replace(t, kept[name])
                os.replace(os.path.join(aside, name), t)
                done.append(name)
        except OSError:
            for name in done:
                targets[name].unlink(missing_ok=True)
            for name, old in kept.items():
                os.replace(old, targets[name])
            raise


def write_shards(df: DataFrame, path: str, keys: list[str]) -> dict[str, str]:
    """JSON lines by shard; returns the SHA-256 of each shard's sorted lines."""
    lines = df.select(F.concat_ws("/", *keys).alias("shard"), F.to_json(F.struct(*df.columns)).alias("line"))
    df.repartition(*keys).write.partitionBy(*keys).json(path)
    per = lines.groupBy("shard").agg(F.sort_array(F.collect_list("line")).alias("x"))
    return {r.shard: r.h for r in per.select("shard", F.sha2(F.array_join("x", "\n"), 256).alias("h")).collect()}


def sha256_json(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
