"""What the jobs' command lines share: a config file, options that go before it, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from pagewright.session import build_session

log = logging.getLogger("pagewright.jobs")


def read_config(spark: SparkSession, path: str | None) -> dict:
    """The settings of a JSON file, which Spark reads, so it may lie anywhere."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path, or no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(name: str, doc: str, paths: tuple[str, ...], run: Callable[..., object]) -> None:
    """Run a job with the paths and settings of its config file; options of the command line go first."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("--config", help="a JSON file of settings")
    for path in paths:
        parser.add_argument(f"--{path}")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build_session(name)
    try:
        settings = read_config(spark, given.pop("config")) | {k: v for k, v in given.items() if v is not None}
        missing = [p for p in paths if not settings.get(p)]
        if missing:
            parser.error(f"no path given for {', '.join(missing)}")
        run(spark, **settings)
    finally:
        spark.stop()
