"""The algorithms from a shell: ``python -m orbweave pagerank -g edges.bin``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from orbweave.operators import algorithms, engine
from orbweave.operators.graph import Graph
from orbweave.sources import edges, reports


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="orbweave")
    parser.add_argument("-v", "--verbose", action="store_true", help="log every round")
    apps = parser.add_subparsers(dest="app", required=True)
    for name in ("pagerank", "sssp", "cc", "kcore"):
        app = apps.add_parser(name)
        app.add_argument("-g", required=True, metavar="graph", help="edge list: packed pairs if it ends in .bin, else text")
        app.add_argument("-t", type=int, default=1000, metavar="threshold", help="in-degree above which a vertex counts as high (statistics only)")
        app.add_argument("-o", metavar="folder", help="write all values there, as Parquet")
        if name == "sssp":
            app.add_argument("-s", type=int, default=0, metavar="source")
        if name == "kcore":
            app.add_argument("-k", type=int, default=0, metavar="K")
        if name in ("cc", "kcore"):
            app.add_argument("-p", metavar="folder", help="write a DOT line for each vertex")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> engine.Run:
    args = arguments().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    if not args.verbose:
        logging.getLogger("py4j").setLevel(logging.ERROR)
    spark = spark or SparkSession.builder.appName(f"orbweave {args.app}").getOrCreate()
    raw = edges.read_binary(spark, args.g, signed=args.app == "kcore") if args.g.endswith(".bin") else edges.read_text(spark, args.g)
    graph = Graph(raw)
    stats = graph.load_stats(spark.sparkContext.defaultParallelism, args.t).first()
    for name in ("low_master", "high_master", "low_mirror", "high_mirror"):
        print(f"{name}: {stats[name]}")
    program = {
        "pagerank": algorithms.PageRank,
        "sssp": lambda: algorithms.ShortestPaths(args.s),
        "cc": algorithms.Components,
        "kcore": lambda: algorithms.KCore(args.k),
    }[args.app]()
    run = engine.run(graph, program, counts=True)
    print(*run.lines(), sep="\n")
    if args.o:
        run.vertices.select("id", "value").write.mode("overwrite").parquet(args.o)
    if getattr(args, "p", None):
        named = run.vertices.withColumnRenamed("value", "component" if args.app == "cc" else "core_value")
        lines = reports.component_dot(named) if args.app == "cc" else reports.core_dot(named, args.k)
        reports.write_lines(lines, args.p)
    return run


if __name__ == "__main__":
    main()
