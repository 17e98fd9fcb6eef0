"""Scenes, catalogue entries, sites and boundaries derived from the star-schema tables.

``*_SQL`` texts run unchanged on Spark and DuckDB, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SIZE = 24

#: One row for each observation of a cell: wide by band.
PIXELS_SQL = f"""
SELECT CAST(l_suppkey % 5 AS INT) AS site_id, CAST(l_shipdate AS DATE) AS scene_date,
  CAST(l_partkey % {SIZE} + 1 AS INT) AS r, CAST((l_orderkey + l_linenumber) % {SIZE} + 1 AS INT) AS c,
  0.10 + l_quantity / 200.0 + CASE WHEN (l_partkey % {SIZE} - 11) * (l_partkey % {SIZE} - 11) + ((l_orderkey + l_linenumber) % {SIZE} - 11) * ((l_orderkey + l_linenumber) % {SIZE} - 11) <= 49 THEN 0.25 ELSE 0.0 END AS nir,
  0.02 + l_discount AS red, 0.01 + l_tax AS blue, 0.03 + l_discount / 2.0 + l_tax / 2.0 AS green,
  0.05 + l_quantity / 400.0 AS swir1, 0.04 + l_tax * 2.0 AS swir2,
  0.06 + l_discount + l_quantity / 1000.0 AS re1, 0.08 + l_quantity / 500.0 AS re2, 0.09 + l_quantity / 300.0 AS re3,
  CAST(l_linenumber AS INT) AS qa, l_orderkey AS tile
FROM lineitem"""

#: One row for each catalogue entry.
CATALOGUE_SQL = """
SELECT o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS scene_date, CAST(floor(o_totalprice) AS BIGINT) % 101 AS cloud,
  CASE o_orderstatus WHEN 'O' THEN 'landsat-8' WHEN 'F' THEN 'landsat-9' ELSE 'landsat-7' END AS platform,
  CAST(o_custkey AS BIGINT) AS tile, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS major,
  CAST(o_orderkey % 12 AS INT) AS minor, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS generation
FROM orders"""

#: Points over all zones, some in the exceptional ones.
SITES_SQL = """
SELECT CAST(s_suppkey AS BIGINT) AS site_id, CAST(s_suppkey * 37 % 3600 AS DOUBLE) / 10.0 - 180.0 AS lon, CAST(s_suppkey * 53 % 1700 AS DOUBLE) / 10.0 - 85.0 AS lat FROM supplier
UNION ALL SELECT -1, 6.0, 60.0 UNION ALL SELECT -2, 15.0, 75.0 UNION ALL SELECT -3, 180.0, 0.0 UNION ALL SELECT -4, 117.8, -32.0"""

#: Polygon edges for each nation: a square and an L on the cell grid.
EDGES_SQL = """
SELECT n_nationkey AS poly_id, n_nationkey % 5 AS site_id, CAST(2000 + n_nationkey AS INT) AS source_year, e.x1 + n_nationkey % 7 AS x1, e.y1 + n_nationkey % 4 AS y1, e.x2 + n_nationkey % 7 AS x2, e.y2 + n_nationkey % 4 AS y2
FROM nation JOIN (
  SELECT 0 AS kind, 3.0 AS x1, 4.0 AS y1, 14.0 AS x2, 4.0 AS y2 UNION ALL SELECT 0, 14.0, 4.0, 14.0, 12.0 UNION ALL SELECT 0, 14.0, 12.0, 3.0, 12.0 UNION ALL SELECT 0, 3.0, 12.0, 3.0, 4.0
  UNION ALL SELECT 1, 2.0, 2.0, 12.0, 2.0 UNION ALL SELECT 1, 12.0, 2.0, 12.0, 6.0 UNION ALL SELECT 1, 12.0, 6.0, 6.0, 6.0 UNION ALL SELECT 1, 6.0, 6.0, 6.0, 15.0 UNION ALL SELECT 1, 6.0, 15.0, 2.0, 15.0 UNION ALL SELECT 1, 2.0, 15.0, 2.0, 2.0
) e ON n_nationkey % 2 = e.kind"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A bridge text over the tables, bound by argument, so nothing is registered in the session."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in sql}
    text = sql
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PIXELS_SQL)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CATALOGUE_SQL)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SITES_SQL)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, EDGES_SQL)
