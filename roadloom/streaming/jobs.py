"""Structured-streaming jobs over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_volume(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(det, hour, volume, n) of a stream or table (event_id, det, ts, volume): repeated events count once, an hour with
    fewer than twelve samples is scaled up, and rows later than ``late`` are dropped by the watermark.

    The watermark bounds the state: one row per sensor and open hour, and one per event id inside the watermark.
    """
    own = events.withWatermark("ts", late)
    once = own.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else own.dropDuplicates(["event_id"])
    hours = once.groupBy("det", F.window("ts", "1 hour").alias("w")).agg(F.sum("volume").alias("total"), F.count("*").alias("n"))
    full = F.when(F.col("n") < 12, F.col("total") * F.lit(12.0) / F.col("n")).otherwise(F.col("total").cast("double"))
    return hours.select("det", F.col("w.start").alias("hour"), full.alias("volume"), "n")


def signal_means(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """(id, hour, cycle_s, samples) of a signal log (id, ts, cycle)."""
    hours = log.withWatermark("ts", late).groupBy("id", F.window("ts", "1 hour").alias("w")).agg(F.avg("cycle").alias("cycle_s"), F.count("*").alias("samples"))
    return hours.select("id", F.col("w.start").alias("hour"), "cycle_s", "samples")


def frame_rollup(pings: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(second, n, mean_speed) of position pings (ts, speed); pings without a speed are left out."""
    rows = pings.where("speed is not null and speed >= 0").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed")).select(F.col("w.start").alias("second"), "n", "mean_speed")


def write_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """The rows of a micro-batch as the part ``batch=N`` of a table. A batch that comes again after a failure replaces its
    own part, so nothing is counted twice, and other parts stay."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def write_stream(rows: DataFrame, folder: str, state: str, mode: str = "append") -> StreamingQuery:
    """Starts a query over what there is now that writes each batch of ``rows`` to ``folder`` once, whatever is replayed;
    ``state`` is its checkpoint. Both folders must be shared."""
    sink = rows.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, folder))
    return sink.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of the rows that ``write_stream`` wrote in update mode, the last of each key."""
    rows = spark.read.parquet(folder)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return best.select(*keys, "r.*")
