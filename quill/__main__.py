"""python -m quill: list the queries, run or explain one over a directory of tables, plan a question, parse a text file."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quill")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("tables")
        c.add_argument("--out", help="write parquet here instead of showing rows")
    c = sub.add_parser("plan")
    c.add_argument("question")
    c.add_argument("--lexicon", help="JSON file")
    c.add_argument("--max-searches", type=int, default=12)
    c = sub.add_parser("parse")
    c.add_argument("file")
    c.add_argument("--outline", action="store_true")
    a = p.parse_args(argv)
    if a.command == "plan":
        from .plans.planner import Planner

        lexicon = {}
        if a.lexicon:
            with open(a.lexicon, encoding="utf-8") as f:
                lexicon = json.load(f)
        print(json.dumps(Planner(lexicon).plan(a.question, a.max_searches).as_dict(), ensure_ascii=False, indent=1))
        return 0
    if a.command == "parse":
        from .operators.parser import parse

        with open(a.file, encoding="utf-8") as f:
            for row in parse(a.file, enumerate(f.read().split("\f"), 1), a.outline):
                print(json.dumps(row, ensure_ascii=False))
        return 0
    from .catalogue import QUERIES

    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = QUERIES[a.query](spark, a.tables)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(50, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main())
