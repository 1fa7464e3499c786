"""``python -m paritas.cli audit --data data.csv --schema "..." --config config.json --output folder``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

#: Exit codes.
OK, USAGE, INPUT, CONFIG, AUDIT, OUTPUT = range(6)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="paritas")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit")
    for name in ("--data", "--schema", "--config", "--output"):
        a.add_argument(name, required=True)
    a.add_argument("--format", action="append", choices=("json", "csv", "html"))
    a.add_argument("--overwrite", action="store_true")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    from pyspark.sql import SparkSession

    from paritas.audit import run_audit
    from paritas.config import ConfigError, from_json
    from paritas.operators.validate import AuditDataError
    from paritas.sources import files

    try:
        config = from_json(Path(args.config).read_text("utf-8"))
    except (ConfigError, ValueError, OSError, TypeError) as e:
        print(f"config: {e}", file=sys.stderr)
        return CONFIG
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        data = files.read_csv(spark, args.data, args.schema)
    except Exception as e:
        print(f"data: {e}", file=sys.stderr)
        return INPUT
    try:
        result = run_audit(data, config)
    except AuditDataError as e:
        print(f"audit: {e}", file=sys.stderr)
        return AUDIT
    texts = {}
    for kind in args.format or files.SINKS:
        texts[files.SINKS[kind].file] = files.SINKS[kind].text(result)
    try:
        files.publish(texts, args.output, args.overwrite)
    except OSError as e:
        print(f"output: {e}", file=sys.stderr)
        return OUTPUT
    return OK


if __name__ == "__main__":
    sys.exit(main())
