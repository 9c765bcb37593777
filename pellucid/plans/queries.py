"""All SQL-expressible queries: their names, how Spark runs them, and the text that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pellucid.functions.dialect import Duck, Spark
from pellucid.operators import links, requests, rollup, semantic, splitting, visual
from pellucid.plans.shared import written

TABLES = ("documents", "pages", "conversations", "events")
QUERIES: dict[str, Callable[[Spark], str]] = {}
for _module in (semantic, links, splitting, requests, visual, rollup):
    QUERIES |= _module.QUERIES


#: Narrow rows that are extracted from whole pages: where a query reads them more than once, they are written once.
EXTRACTED = {"link-targets": links.targets}


def _over(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    views = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables)
    return spark.sql(f"WITH {views} {text}" if tables else text)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named query over the Parquet tables of a folder; only the tables it names are read."""
    text = QUERIES[name](Spark())
    for table, make in EXTRACTED.items():
        if text.count(rows := make(Spark())) > 1:
            path = written(_over(spark, sf_dir, f"SELECT * FROM {rows} t"), table)
            text = text.replace(rows, f"(SELECT * FROM parquet.`{path}`)")
    return _over(spark, sf_dir, text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(name, spark, sf_dir)) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: make(Duck()) for name, make in QUERIES.items()}
