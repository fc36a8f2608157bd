"""The log's incremental parts as structured streams: first-hit labels, and counts, of events that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.operators.labels import Label


def first_hits(rows: DataFrame, rules: list[Label]) -> DataFrame:
    """Row-rule labels of one table as a streaming aggregation: a running minimum per stay and label (output mode update)."""
    made = F.array(*[F.struct(F.lit(s.code).alias("code"), F.when(F.expr(s.when), F.col(s.time)).alias("time")) for s in rules])
    hits = rows.select("hospitalization_id", F.inline(F.filter(made, lambda x: x.time.isNotNull())))
    return hits.groupBy("hospitalization_id", "code").agg(F.min("time").alias("time"))


def event_counts(events: DataFrame, window: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Events per stay and clock window, closed once the watermark has passed (time is a timestamp)."""
    timed = events.withWatermark("time", late)
    return timed.groupBy("hospitalization_id", F.window("time", window)).agg(F.count("*").alias("n"))
