"""Command line: spark-submit -m loamworks.plans.cli clean-data ... | scrape ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loamworks.operators import gates
from loamworks.plans import pipeline, report
from loamworks.sources import fetch, html


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamworks")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean-data")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--row-id")
    c.add_argument("--output-format", choices=["parquet", "csv", "both"], default="parquet")
    c.add_argument("--disable-quarantine", action="store_true")
    c.add_argument("--rules", help="JSON file of quality rules by domain, as gates.from_spec reads them")
    c.add_argument("--domain", default="general", help="whose rules of the file hold; general has none unless the file gives some")
    c.add_argument("--disable-quality-gates", action="store_true")
    s = sub.add_parser("scrape")
    s.add_argument("urls", help="text file, a url on each line")
    s.add_argument("output")
    return p


def rules_of(spark: SparkSession, path: str | None, domain: str) -> list[gates.Rule]:
    """The rules of a domain in a file {domain: [records]}; a domain that it lacks is an error, but for general."""
    if path is None:
        if domain != "general":
            raise ValueError("a domain other than general needs --rules")
        return []
    by = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    if domain not in by and domain != "general":
        raise ValueError(f"no rules of domain {domain} in {path}")
    return gates.from_spec(by.get(domain, []))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("loamworks").getOrCreate()
    if a.command == "clean-data":
        rules = [] if a.disable_quality_gates else rules_of(spark, a.rules, a.domain)
        done = pipeline.clean_file(spark, a.input, a.output, rules, row_id=a.row_id, kind=a.output_format, quarantine=not a.disable_quarantine)
        print(done)
        return int(not done.success)
    pages = fetch.fetch_pages(spark.read.text(a.urls).withColumnRenamed("value", "url"))
    print(report.write_cards(html.explode_cards(html.extract(pages.filter("success"))), a.output))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
