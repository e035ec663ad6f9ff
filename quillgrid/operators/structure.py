"""Grids as DataFrames of cells: blocks of rows, and merged cells filled from their anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

#: Rows of a band: merges are dealt to the bands they touch, so the range join is an equality join.
BAND = 256


def islands(cells: DataFrame, by: list[str], along: str) -> DataFrame:
    """(by, first_row, last_row, filled): runs of consecutive places that have a cell; a gap of one ends a run."""
    places = cells.select(*by, along).distinct()
    island = F.col(along) - F.row_number().over(Window.partitionBy(*by).orderBy(along))
    runs = places.withColumn("_island", island).groupBy(*by, "_island")
    return runs.agg(F.min(along).alias("first_row"), F.max(along).alias("last_row"), F.count("*").alias("filled")).drop("_island")


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Blank cells under a merge take its anchor's value; cells with a value of their own keep it.

    merges: (sheet, top, bottom, left, right, anchor). Each is dealt to the bands of rows that it covers and met
    there, so no pair of a cell and a merge elsewhere is formed.
    """
    band = lambda c: F.floor(F.col(c) / BAND)
    spread = merges.withColumn("_band", F.explode(F.sequence(band("top"), band("bottom")))).withColumnRenamed("sheet", "_sheet")
    placed = cells.withColumn("_at", band("r"))
    met = placed.join(spread, (F.col("sheet") == F.col("_sheet")) & (F.col("_at") == F.col("_band")) & F.col("r").between(F.col("top"), F.col("bottom")) & F.col("c").between(F.col("left"), F.col("right")), "left")
    empty = values.blank(F.col("value"))
    return met.select(*cells.columns[:-1], F.when(empty, F.coalesce("anchor", "value")).otherwise(F.col("value")).alias("value"), (empty & F.col("anchor").isNotNull()).alias("inherited"))
