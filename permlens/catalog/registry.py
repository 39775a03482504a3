"""All registered queries and statements, by section."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from permlens.plans.corpus import Corpus

SECTIONS = ["sources", "access", "text", "versions", "retrieval", "answers", "metrics", "statistics", "loads", "audit", "streams"]


def _modules():
    return [importlib.import_module(f"permlens.catalog.{name}") for name in SECTIONS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Corpus(spark, sf_dir))

    return {name: bind(build) for module in _modules() for name, build in module.QUERIES.items()}


def statements() -> dict[str, str]:
    return {name: statement for module in _modules() for name, statement in module.SQL.items()}
