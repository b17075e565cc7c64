"""Structured-streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(urls: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them by late."""
    return urls.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in each window of event time; a window is out once the watermark has passed it."""
    return events.withWatermark("date_detection", late).groupBy(F.window("date_detection", window).alias("fenetre"), "type_evenement").agg(F.count("*").alias("n"))
