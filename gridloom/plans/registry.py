"""Named queries over the sample tables, each beside the SQL that must agree with it."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

# Who and when, for operations that stamp rows.
USER = "editor"
NOW = datetime.datetime(2024, 6, 1, 12, 0, 0)


@dataclass(frozen=True)
class Plan:
    run: Run
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in PLANS:
            raise ValueError(f"query registered twice: {name}")
        PLANS[name] = Plan(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
