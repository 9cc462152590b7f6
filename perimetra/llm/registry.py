"""The registered queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def keep(job: Job) -> Job:
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Job], dict[str, str]]:
    from perimetra.llm import queries  # noqa: F401

    return JOBS, SQL
