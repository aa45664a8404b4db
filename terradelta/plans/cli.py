"""Command line: ``python -m terradelta.plans.cli --aoi bergen --start 2018-06 --end 2018-09 ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..schema import PipelineError
from .pipeline import AREAS, run_pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Change polygons between consecutive months of an area.")
    p.add_argument("--aoi", required=True, choices=sorted(AREAS))
    p.add_argument("--start", required=True, help="first month, YYYY-MM")
    p.add_argument("--end", required=True, help="last month, YYYY-MM")
    p.add_argument("--observations", required=True, help="Parquet of pixel observations")
    p.add_argument("--scenes", required=True, help="Parquet of scenes")
    p.add_argument("--grid", required=True, help="JSON of the grid: x0, y0, res_x, res_y, height, width")
    p.add_argument("--output", default="output")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("terradelta").getOrCreate()
    grid = json.loads(args.grid)
    try:
        path = run_pipeline(spark, args.aoi, args.start, args.end, spark.read.parquet(args.observations), spark.read.parquet(args.scenes), args.output, height=grid["height"], width=grid["width"], header=grid)
    except PipelineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
