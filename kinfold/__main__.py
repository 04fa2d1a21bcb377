"""``python -m kinfold run|merge|review|resolve|prune ...``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from kinfold.operators import review
from kinfold.plans import commands
from kinfold.sources import logs


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinfold")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("merge", help="two exports to merged cards, cards for review and a report")
    q = sub.add_parser("run", help="merge, apply decisions, resolve")
    for x in (p, q):
        x.add_argument("icloud")
        x.add_argument("google")
        x.add_argument("--out", required=True)
    p.add_argument("--review", required=True)
    p.add_argument("--report", required=True)
    q.add_argument("--decisions")
    q.add_argument("--report")
    q.add_argument("--keep", action="store_true")
    p = sub.add_parser("review", help="write a log's decisions into a report; show what is next")
    p.add_argument("--report", required=True)
    p.add_argument("--decisions", required=True)
    p = sub.add_parser("resolve", help="apply a report's decisions to the files of a merge")
    for flag in ("report", "review", "merged", "out"):
        p.add_argument(f"--{flag}", required=True)
    p = sub.add_parser("prune")
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--removed")
    p.add_argument("--reachable-by", default="email,phone,address")
    p.add_argument("--skip-malformed", action="store_true")
    p.add_argument("--json", action="store_true")
    sub.add_parser("version")
    a = parser.parse_args(argv)
    if a.command == "version":
        print("kinfold 0.1")
        return
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    if a.command == "merge":
        commands.merge(spark, a.icloud, a.google, a.out, a.review, a.report)
    elif a.command == "run":
        try:
            commands.run(spark, a.icloud, a.google, a.out, a.decisions, a.report, a.keep)
        except commands.Paused as e:
            sys.exit(str(e))
    elif a.command == "review":
        pending = commands.apply_decisions(spark, a.report, a.decisions)
        print(review.session_summary(logs.read(spark, a.decisions), pending))
        for r in review.next_pending(commands.review_state(spark, a.report, a.decisions)).collect():
            print(f"  Next: {r['cluster_id']} ({r['score']:.2f})")
    elif a.command == "resolve":
        commands.resolve(spark, a.report, a.review, a.merged, a.out)
    else:
        result = commands.run_prune(spark, a.path, a.out, a.removed, a.reachable_by, a.skip_malformed)
        print(json.dumps(result, ensure_ascii=False, indent=2) if a.json else commands.prune_text(result))


if __name__ == "__main__":
    main()
