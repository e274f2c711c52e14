"""Simulator output by interval and edge, read as hourly flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.text import base_id

HOUR_S, SLACK_S = 3600, 1
_EDGE = "struct<_id: string, _flow: double, _speed: double, _sampledSeconds: double>"


def hourly_flows(rows: DataFrame, start_hour: int) -> DataFrame:
    """(hour, eid, flow) of rows (id, begin, end, flow): intervals that last an hour, ids that are their own base."""
    whole = rows.where(F.abs(F.col("end") - F.col("begin") - HOUR_S) <= SLACK_S)
    own = whole.withColumn("eid", base_id(F.col("id"))).where(F.col("eid").cast("string") == F.col("id"))
    return own.select((F.lit(start_hour) + F.bround(F.col("begin") / HOUR_S, 0)).cast("long").alias("hour"), "eid", "flow")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(id, begin, end, flow, speed, sampled_s) of XML files of <interval> with <edge> rows."""
    schema = f"_begin double, _end double, edge array<{_EDGE}>"
    rows = spark.read.format("xml").option("rowTag", "interval").schema(schema).load(path).select("_begin", "_end", F.explode("edge").alias("e"))
    return rows.select(F.col("e._id").alias("id"), F.col("_begin").alias("begin"), F.col("_end").alias("end"), F.col("e._flow").alias("flow"), F.col("e._speed").alias("speed"), F.col("e._sampledSeconds").alias("sampled_s"))
