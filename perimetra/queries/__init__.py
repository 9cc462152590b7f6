"""Registered queries: each pairs a Spark job on the given tables with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.jobs: dict[str, Job] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Job], Job]:
        def keep(job: Job) -> Job:
            self.jobs[name] = job
            if sql is not None:
                self.sql[name] = sql
            return job

        return keep


REGISTRY = Registry()


def load() -> Registry:
    from perimetra.queries import alerts, boards, boxes, controls, fusion, policy, site, tracks  # noqa: F401

    return REGISTRY
