"""Command line: resolves record files into one JSON array of profiles."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators.project import Config
from .plans.engine import Engine, write_json_array
from .sources.files import load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="confluo", description="Fuses records about people from CSV, JSON, resumes and notes.")
    p.add_argument("--config", help="projection configuration (JSON)")
    for kind in ("csv", "ats", "resume", "notes"):
        p.add_argument(f"--input-{kind}", action="append", default=[], help=f"a {kind} file; may be repeated")
    p.add_argument("--output", required=True, help="the JSON file to write")
    p.add_argument("--pretty", action="store_true", help="indent the output")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = load_config(args.config)
        omit = Config(config).on_missing == "omit"
        spark = SparkSession.builder.appName("confluo").getOrCreate()
        out = Engine(spark).run(config, csv=args.input_csv, ats=args.input_ats, resume=args.input_resume, notes=args.input_notes)
        write_json_array(out, args.output, pretty=args.pretty, omit_null=omit)
    except (ValueError, OSError, PySparkException) as exc:
        print(f"error: {exc}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
