"""Command line: python -m knotwork <command>."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from knotwork import __version__
from knotwork.plans.engine import Engine, ShrinkError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knotwork", description="Knowledge graphs of source trees on Spark.")
    p.add_argument("--version", action="version", version=f"knotwork {__version__}")
    sub = p.add_subparsers(dest="command")

    def command(name: str, *arguments: tuple) -> None:
        c = sub.add_parser(name)
        for names, options in arguments:
            c.add_argument(*names.split(), **options)

    path, graph, flag = ("path", {"nargs": "?", "default": "."}), ("--graph", {"default": None}), {"action": "store_true"}
    command("build", path, ("--no-viz", flag), ("--no-cluster", flag), ("--out", {"default": None}), ("--force", flag))
    command("update", path, ("--no-cluster", flag), ("--force", flag))
    command("cluster-only", path, graph, ("--resolution", {"type": float, "default": 1.0}))
    command("query", ("question", {}), graph, ("--dfs", flag), ("--depth", {"type": int, "default": 3}), ("--budget", {"type": int, "default": 2000}))
    command("explain", ("node", {}), graph)
    command("path", ("a", {}), ("b", {}), graph)
    command("affected", ("node", {}), graph, ("--depth", {"type": int, "default": 2}))
    command("export", ("kind", {}), ("--output", {"default": None}), ("--max-sections", {"type": int, "default": 5}))
    command("watch", path)
    return p


def run(engine: Engine, a: argparse.Namespace) -> int:
    match a.command:
        case "build":
            print(engine.build(a.path, not a.no_viz, not a.no_cluster, a.force))
        case "update":
            print(engine.update(a.path, not a.no_cluster))
        case "cluster-only":
            print(f"{engine.recluster(a.resolution, a.graph)} communities")
        case "query":
            print(engine.query(a.question, a.depth, a.budget, "dfs" if a.dfs else "bfs", a.graph))
        case "explain":
            print(engine.explain(a.node, a.graph))
        case "path":
            print(engine.path(a.a, a.b, a.graph))
        case "affected":
            print(engine.affected(a.node, a.depth, a.graph))
        case "export":
            if a.kind != "callflow-html":
                print(f"unknown export kind {a.kind}", file=sys.stderr)
                return 2
            print(engine.export_callflow(a.output, a.max_sections))
        case "watch":
            from knotwork.streaming.watch import watch

            query = watch(engine, a.path)
            try:
                query.awaitTermination()
            except KeyboardInterrupt:
                query.stop()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command is None:
        parser().print_help()
        return 0
    spark = spark or SparkSession.builder.appName("knotwork").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    try:
        return run(Engine(spark, getattr(a, "out", None)), a)
    except (ShrinkError, FileNotFoundError) as e:
        print(f"knotwork: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
