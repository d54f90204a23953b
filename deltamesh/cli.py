"""Command line: compare, inspect, matrix, check, timeline, demo. Exit codes of check: 0 holds, 1 fails, 2 misuse."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from deltamesh.operators.align import AlignOptions
from deltamesh.plans import batch, generators
from deltamesh.plans.report import compare_files, load_baseline, run_checks
from deltamesh.sources import discover_graphs, read_graph, write_graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="deltamesh")
    sub = p.add_subparsers(dest="command", required=True)

    def pair(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("a")
        c.add_argument("b")
        c.add_argument("--align", choices=("exact", "normalized", "fuzzy"), default="exact")
        c.add_argument("--cluster-by")
        c.add_argument("--no-structural", action="store_true")
        c.add_argument("--no-findings", action="store_true")
        return c

    c = pair("compare")
    c.add_argument("--json")
    c.add_argument("--parquet")
    c.add_argument("--union")
    c.add_argument("--page-data")
    c = pair("check")
    c.add_argument("--rule", action="append", default=[])
    c.add_argument("--drift", action="append", default=[], metavar="QUANTITY=TOLERANCE")
    c.add_argument("--baseline")
    c = sub.add_parser("inspect")
    c.add_argument("path")
    c.add_argument("--undirected", action="store_true")
    c = sub.add_parser("matrix")
    c.add_argument("directory")
    c.add_argument("--metric", action="append")
    c.add_argument("--include-self", action="store_true")
    c.add_argument("--parquet")
    c = sub.add_parser("timeline")
    c.add_argument("paths", nargs="+")
    c = sub.add_parser("demo")
    c.add_argument("directory")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("deltamesh").getOrCreate()
    try:
        if args.command in ("compare", "check"):
            options = AlignOptions(method=args.align) if args.align != "exact" else None
            r = compare_files(spark, args.a, args.b, align_options=options, cluster_by=args.cluster_by, structural=not args.no_structural, findings=not args.no_findings)
            if args.command == "check":
                if not args.rule and not args.drift:
                    print("no rule given", file=sys.stderr)
                    return 2
                drift = {k: float(v) for k, v in (x.split("=", 1) for x in args.drift)}
                done = run_checks(r, args.rule, load_baseline(args.baseline) if args.baseline else None, drift)
                print(done.summary())
                return 0 if done.ok else 1
            print(r.to_markdown())
            if args.json:
                r.to_json(args.json)
            if args.parquet:
                r.to_parquet(args.parquet)
            if args.union:
                r.union_to_parquet(args.union)
            if args.page_data:
                with open(args.page_data, "w", encoding="utf-8") as f:
                    json.dump(r.page_data(), f)
        elif args.command == "inspect":
            print(json.dumps(read_graph(spark, args.path, directed=not args.undirected).inspect(), indent=2))
        elif args.command == "matrix":
            t = batch.matrix_of_files(spark, discover_graphs(args.directory), args.metric, args.include_self)
            if args.parquet:
                t.write.mode("overwrite").parquet(args.parquet)
            else:
                t.show(1000, truncate=False)
        elif args.command == "timeline":
            print(batch.timeline([read_graph(spark, p) for p in args.paths]).to_markdown())
        else:
            for name, g in zip(("a", "b"), generators.block_pair(spark), strict=True):
                write_graph(g, f"{args.directory}/{name}.graphml")
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
