"""Command line: ``run`` analyses logs, ``benchmark`` times a synthetic log."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import pipeline, synthetic
from .sources import files, scratch


def session() -> SparkSession:
    return SparkSession.builder.appName("eventlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="eventlens")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="analyse log files")
    run.add_argument("inputs", nargs="+")
    run.add_argument("--out", required=True)
    run.add_argument("--dictionary")
    run.add_argument("--warehouse")
    run.add_argument("--run-id")
    run.add_argument("--sample", type=int, default=20)
    bench = commands.add_parser("benchmark", help="time an analysis of a synthetic log")
    bench.add_argument("--rows", type=int, default=10_000)
    bench.add_argument("--users", type=int)
    given = parser.parse_args(args)
    spark = session()
    if given.command == "run":
        found = pipeline.run_pipeline(spark, given.inputs, given.out, given.dictionary, given.run_id, given.warehouse, given.sample)
        print(json.dumps(found["summary"], ensure_ascii=False))
        return 0
    folder = scratch.new_folder(spark, "benchmark")
    try:
        made = synthetic.timed(lambda: synthetic.synthetic_log(spark, given.rows, given.users).drop("_src").write.csv(f"{folder}/log", header=True))
        size = sum(h.size for h in files.heads(spark, files.discover(spark, [f"{folder}/log"])))
        spent = synthetic.timed(lambda: pipeline.run_pipeline(spark, [f"{folder}/log"], f"{folder}/out", store=f"{folder}/store"))
    finally:
        scratch.remove(spark, folder)
    print(json.dumps({"rows": given.rows, "input_size_mb": round(size / 1e6, 3), "generate_sec": made,
                      "pipeline_sec": spent, "total_sec": round(made + spent, 3)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
