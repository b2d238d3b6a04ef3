"""Command line: ``python -m confluo.cli -i PATH [PATH ...] [-c CONFIG] [-o OUT] [--default-country CC] [--pdf-text MODULE:FUNCTION]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.project import parse_config, to_records, validate_records
from .plans.transform import CANONICAL, Result, transform, validate
from .sources.load import load_sources, text_extractor


def records(result: Result) -> DataFrame:
    """(candidate_id, record): one JSON text per profile."""
    if result.config:
        return to_records(result.profiles, result.config)
    return result.profiles.select("candidate_id", F.to_json(F.struct(*CANONICAL), {"ignoreNullFields": "false"}).alias("record"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="confluo", description="Resolve and fuse records of people into profiles.")
    p.add_argument("-i", "--inputs", nargs="+", required=True, help="files or directories")
    p.add_argument("-c", "--config", help="output config (JSON)")
    p.add_argument("-o", "--out", help="file to write; a path that ends with / becomes a folder of JSON lines, written by the executors")
    p.add_argument("--default-country", help="ISO alpha-2 hint for phone numbers without a country code")
    p.add_argument("--pdf-text", help="package.module:function that turns the bytes of a PDF into text")
    p.add_argument("--compact", action="store_true", help="no indentation")
    p.add_argument("--quiet", action="store_true", help="no summary on stderr")
    a = p.parse_args(argv)
    try:
        config = parse_config(json.load(open(a.config, encoding="utf-8"))) if a.config else None
        spark = SparkSession.builder.getOrCreate()
        sources, skipped = load_sources(spark, a.inputs, text_extractor(a.pdf_text) if a.pdf_text else None)
        result = transform(sources, config, a.default_country)
        validate(result.profiles)
        if result.records is not None:
            validate_records(result.records, result.config)
        rows = records(result)
        if a.out and a.out.endswith("/"):
            rows.select(F.col("record").alias("value")).write.text(a.out)
            count = result.profiles.count()
        else:
            found = [json.loads(r.record) for r in rows.orderBy("candidate_id").toLocalIterator()]
            count = len(found)
            text = json.dumps(found, ensure_ascii=False, indent=None if a.compact else 2, separators=(",", ":") if a.compact else None) + "\n"
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                sys.stdout.write(text)
        if not a.quiet:
            print(f"{count} profile(s) from {sources.count()} source(s)", file=sys.stderr)
            for r in skipped.toLocalIterator():
                print(f"skipped {r['name']}: {r['reason']}", file=sys.stderr)
            for r in result.failed.toLocalIterator():
                print(f"unreadable {r['name']}: {r['reason']}", file=sys.stderr)
            for r in result.diagnostics().toLocalIterator():
                print(r["message"], file=sys.stderr)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
