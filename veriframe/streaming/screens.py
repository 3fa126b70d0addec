"""Digit screen over a stream of cells, in event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N


def digit_counts(cells: DataFrame, ts: str, by: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    c = F.col("raw")
    numeric = cells.where(N.is_number(c)).withWatermark(ts, late)
    return numeric.groupBy(F.window(ts, window), *by, N.last_digit(c).alias("last_digit")).agg(F.count("*").alias("n"))
