"""Grids that grow: pixels of a stream added up on a lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulate(pixels: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """(y, x, v): sums of a stream of (y, x, v), for output mode update or complete.

    watermark: (time column, delay); sums are then kept for each event time, and those past the delay are let go.
    """
    if watermark is None:
        return pixels.groupBy("y", "x").agg(F.sum("v").alias("v"))
    column, delay = watermark
    return pixels.withWatermark(column, delay).groupBy(column, "y", "x").agg(F.sum("v").alias("v"))
