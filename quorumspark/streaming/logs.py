"""Running totals and windows of append-only logs: the same on a stream as on a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(scored: DataFrame, by: list[str], value: str = "abs_dev") -> DataFrame:
    """Sum, count and mean a group: the same on a stream (complete mode) as on a table."""
    return scored.groupBy(*by).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.avg(value).alias("mean"))


def windowed(events: DataFrame, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts and sums of event-time windows; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
