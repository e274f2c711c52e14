from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from roadloom.streaming.jobs import frame_rollup, hourly_volume, signal_means


def closed(rows, at, base, late, width):
    """The rows whose window has ended by the last watermark."""
    units = {"hours": 3600, "hour": 3600, "seconds": 1, "second": 1}
    seconds = lambda text: int(text.split()[0]) * units[text.split()[1]]
    # The job on speeds sees only rows that have one, so the greatest time is taken of those it sees.
    seen = base.where("speed is not null") if width == "1 second" else base
    last = seen.agg(F.max("ts")).first()[0].timestamp() - seconds(late)
    return {r for r in rows if r[at].timestamp() + seconds(width) <= last}


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    base = spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("det"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), (F.col("id") % 7).alias("volume"),
        (F.col("id") % 4).alias("id"), (60 + F.col("id") % 90).alias("cycle"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("double").alias("speed"),
    )
    base.union(base.where("event_id < 50")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    got = set(map(tuple, run(spark, hourly_volume(stream()), "hv").collect()))
    want = set(map(tuple, hourly_volume(batch).collect()))
    assert got == closed(want, 1, base, "2 hours", "1 hour")
    got = set(map(tuple, run(spark, frame_rollup(stream()), "fr").collect()))
    assert got == closed(set(map(tuple, frame_rollup(batch).collect())), 0, base, "10 seconds", "1 second")
    got = set(map(tuple, run(spark, signal_means(stream()), "sm").collect()))
    assert got == closed(set(map(tuple, signal_means(batch).collect())), 1, base, "2 hours", "1 hour")
    assert signal_means(batch).agg(F.sum("samples")).first()[0] == 650


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    schema = "event_id long, det long, ts timestamp, volume long"
    row = lambda i, hour, volume: (i, 1, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=hour), volume)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, rows in enumerate(([row(1, 0, 5), row(2, 9, 1)], [row(3, 0, 100), row(4, 8, 7)], [row(5, 20, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = hourly_volume(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
        q.outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
    got = {r["hour"].hour: (r["volume"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (60.0, 1), 8: (84.0, 1), 9: (12.0, 1)}
