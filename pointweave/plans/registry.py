"""Queries by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointweave.plans.ship import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: For DuckDB, which has the tables as views.
PLAIN = {t: t for t in TABLES}


class Inputs:
    """The tables of one folder, as SQL text with ``{table}`` in place of names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self.names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}

    def __call__(self, text: str) -> DataFrame:
        return self.spark.sql(text.format(**self.names))


class Catalog:
    def __init__(self) -> None:
        self.run: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers f(inputs) under its own name; ``sql`` may use ``{table}`` names."""

        def take(f: Callable[[Inputs], DataFrame]):
            name = f.__name__
            self.run[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
            if sql:
                self.sql[name] = sql.format(**PLAIN)
            return f

        return take


CATALOG = Catalog()
query = CATALOG.query

#: Stand-ins: embeddings as points with vectors; lineitem as contributions.
POINTS = "SELECT vec_id AS gid, embedding AS vec, label FROM {embeddings}"
CONTRIBS = """SELECT l_orderkey % 6 AS view_id, l_orderkey AS pixel_id, l_partkey AS gid, l_suppkey AS seg_id,
  l_quantity AS weight, l_discount AS alpha, l_extendedprice AS depth, l_linenumber AS line, l_tax AS tax FROM {lineitem}"""
