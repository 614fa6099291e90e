"""Dot products, absolute sums and Gram matrices kept up over a stream: sums that Structured Streaming maintains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.level3 import tall_gram


def running_gram(stream: DataFrame, columns: list[str | Column]) -> DataFrame:
    """``i, j, v`` of the rows so far (output mode complete)."""
    return tall_gram(stream, columns)


def running_dot(stream: DataFrame, x: str, y: str) -> DataFrame:
    return stream.agg(F.coalesce(F.sum(F.col(x).cast("double") * F.col(y).cast("double")), F.lit(0.0)).alias("value"))


def windowed_asum(stream: DataFrame, x: str, time: str, window: str, late: str) -> DataFrame:
    """``start, value``: sum of |x| per time window; rows later than ``late`` are dropped by the watermark."""
    per = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return per.agg(F.sum(F.abs(F.col(x).cast("double"))).alias("value")).select(F.col("w.start").alias("start"), "value")
