"""Command line: inspect-blocks, compile, trace, eval, version."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="blockwise")
    verbs = out.add_subparsers(dest="verb", required=True)
    blocks = verbs.add_parser("inspect-blocks", help="blocks of the Markdown files of a folder, as JSON lines")
    blocks.add_argument("folder")
    blocks.add_argument("out")
    blocks.add_argument("--target", type=int, default=200)
    blocks.add_argument("--max", type=int, default=400)
    compiled = verbs.add_parser("compile", help="compile Parquet requests and candidates; writes decisions and results")
    compiled.add_argument("requests")
    compiled.add_argument("candidates")
    compiled.add_argument("out")
    trace = verbs.add_parser("trace", help="the decisions of one request")
    trace.add_argument("out")
    trace.add_argument("request")
    report = verbs.add_parser("eval", help="summary of a compiled result's reduction")
    report.add_argument("out")
    verbs.add_parser("version")
    return out


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    if given.verb == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("blockwise").getOrCreate()
    if given.verb == "inspect-blocks":
        from .functions.validate import ChunkOptions
        from .operators.chunk import chunk
        from .operators.tokenizers import Words
        from .sources.ingest import ingest, read_files

        rows, bad = read_files(spark, given.folder, "local", "default", "files")
        chunk(ingest(rows), Words(), ChunkOptions(given.target, given.max)).write.json(given.out)
        return int(not bad.isEmpty())
    if given.verb == "compile":
        from .plans.compile import compile_requests

        done = compile_requests(spark.read.parquet(given.requests), spark.read.parquet(given.candidates))
        for name in ("decisions", "results", "rejected"):
            getattr(done, name).write.parquet(f"{given.out}/{name}")
        return int(not done.rejected.isEmpty())
    if given.verb == "trace":
        spark.read.parquet(f"{given.out}/decisions").where(F.col("request_id") == given.request).select("id", "reason", "rank", "canonical_id", "tokenCount", "score").orderBy("rank", "id").show(1000, truncate=False)
        return 0
    from .plans.metrics import summary

    summary(spark.read.parquet(f"{given.out}/results"), "reduction_ratio").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
