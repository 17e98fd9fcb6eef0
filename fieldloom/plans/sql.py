"""The engine from SQL: scenes as views, indices and windows as SQL functions, results as tables.

Functions are SQL expressions, so a call becomes part of the caller's plan and generated code; no value leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import indices


def index_function(name: str) -> str:
    """SQL that makes the temporary function ``fl_<index>`` over its bands, in the order of ``needed_bands``."""
    bands = indices.needed_bands(name)
    value = f"CAST({indices.index_sql(name)} AS DOUBLE)"
    arguments = ", ".join(f"{b} DOUBLE" for b in bands)
    return f"CREATE OR REPLACE TEMPORARY FUNCTION fl_{name.lower()}({arguments}) RETURNS DOUBLE RETURN CASE WHEN abs({value}) < double('inf') THEN {value} END"


WINDOWS = """CREATE OR REPLACE TEMPORARY FUNCTION fl_windows(first DATE, last DATE, n INT) RETURNS TABLE (w INT, opens DATE, closes DATE)
RETURN SELECT w, date_add(first, CAST(ceil(datediff(last, first) * (w - 1) / n) AS INT)) AS opens, CASE WHEN w = n THEN last ELSE date_add(first, CAST(ceil(datediff(last, first) * w / n) AS INT) - 1) END AS closes
FROM (SELECT explode(sequence(1, n)) AS w)"""


def register(spark: SparkSession, views: dict[str, DataFrame], names: list[str] | None = None) -> None:
    """Temporary views, an ``fl_`` function for each index (or for ``names``) and the table function ``fl_windows``."""
    for name in names if names is not None else indices.FORMULAS:
        spark.sql(index_function(name))
    spark.sql(WINDOWS)
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)


def store(result: DataFrame, table: str, partition: list[str] | None = None, buckets: tuple[int, list[str]] | None = None, mode: str = "errorifexists") -> DataFrame:
    """A result as a Parquet table of the session's catalogue, partitioned, or bucketed by what later joins share."""
    writer = result.write.format("parquet").mode(mode)
    if partition:
        writer = writer.partitionBy(*partition)
    if buckets:
        writer = writer.bucketBy(buckets[0], *buckets[1]).sortBy(*buckets[1])
    writer.saveAsTable(table)
    return result.sparkSession.table(table)
