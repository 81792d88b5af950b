"""Registered queries: each key has a Spark plan and, where SQL can say it, the same result as SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.session import apply_plan_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register `fn(spark, sf_dir)` under a key, with its oracle text."""
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_plan_settings(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        if oracle:
            ORACLES[key] = oracle
        return fn

    return keep
