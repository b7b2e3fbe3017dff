"""The materialised trade tables: built once from flows, read with partition pruning.

Under one folder: ``edges`` (by year and sector), ``country_year``, ``quality`` and ``centrality``
(by year). A rebuild of some years leaves the others as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import graph, trade
from geolith.sources.readers import manifest, write_years

TABLES = ("edges", "country_year", "quality", "centrality")


def build(flows: DataFrame, folder: str, years: list[int] | None = None) -> str:
    """Writes all tables for the given years (all by default); returns the manifest of the edges as JSON."""
    some = flows.where(F.col("year").isin(years)) if years else flows
    edges = trade.sector_rollup(some).drop("n_flows")
    edges.repartition("year", "sector").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "year", "sector"
    ).parquet(f"{folder}/edges")
    kept = edges_of(some.sparkSession, folder).where(F.col("year").isin(years)) if years else edges_of(some.sparkSession, folder)
    write_years(trade.country_year_totals(kept), f"{folder}/country_year")
    write_years(trade.data_quality(some), f"{folder}/quality")
    weights = kept.withColumnRenamed("trade_value", "weight")
    write_years(graph.centrality(weights, "year", "sector"), f"{folder}/centrality")
    return manifest(edges_of(some.sparkSession, folder))


def edges_of(spark: SparkSession, folder: str, year: int | None = None, sector: str | None = None) -> DataFrame:
    """Edges of a year and sector; both are partitions, so other files are not opened."""
    found = spark.read.parquet(f"{folder}/edges")
    if year is not None:
        found = found.where(F.col("year") == year)
    if sector is not None:
        found = found.where(F.col("sector") == sector)
    return found.select("exporter", "importer", "year", "sector", "trade_value")


def history(spark: SparkSession, folder: str, country: str, sector: str = "all") -> DataFrame:
    """A country's totals year by year."""
    rows = spark.read.parquet(f"{folder}/country_year")
    return rows.where((F.col("country") == country) & (F.col("sector") == sector)).orderBy("year")


def centrality_of(spark: SparkSession, folder: str, year: int, sector: str = "all") -> DataFrame:
    rows = spark.read.parquet(f"{folder}/centrality")
    return rows.where((F.col("year") == year) & (F.col("sector") == sector)).select("country", "pagerank", "betweenness")


def quality_of(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """Data quality by sector of one year, or over all years weighted by rows."""
    rows = spark.read.parquet(f"{folder}/quality")
    return rows.where(F.col("year") == year) if year is not None else trade.quality_overall(rows)
