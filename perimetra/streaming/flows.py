"""Streams that need no custom state: pairing, contacts, health, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perimetra.params import FUSION, SENSOR, Fusion, Sensor
from perimetra.sources.stores import write_alert_batch
from perimetra.streaming.keyed import WATERMARK


def paired(optical: DataFrame, thermal: DataFrame, s: Sensor = SENSOR) -> DataFrame:
    """Optical frames with thermal frames inside the clock tolerance, as an interval join."""
    o = optical.withWatermark("ts", WATERMARK).alias("o")
    t = thermal.select("site_id", F.col("ts").alias("t_ts"), F.col("frame_idx").alias("thermal_frame")).withWatermark("t_ts", WATERMARK).alias("t")
    ms = int(s.pair_tolerance_s * 1000)
    near = (F.col("o.ts") >= F.col("t.t_ts") - F.expr(f"INTERVAL {ms} MILLISECONDS")) & (
        F.col("o.ts") <= F.col("t.t_ts") + F.expr(f"INTERVAL {ms} MILLISECONDS")
    )
    return o.join(t, (F.col("o.site_id") == F.col("t.site_id")) & near).select("o.*", "t.thermal_frame", "t.t_ts")


def contact_sessions(contacts: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """Stays of optical contacts, closed by the watermark."""
    gap = f"{p.contact_gap_s} seconds"
    w = F.session_window("ts", gap)
    return (
        contacts.withWatermark("ts", WATERMARK)
        .groupBy("site_id", "key", w.alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .withColumn("dwell_s", F.col("last_seen").cast("double") - F.col("first_seen").cast("double"))
        .drop("w")
    )


def log_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the open and close records of ``keyed.alerts`` as they come, in one folder per micro-batch: a replayed batch replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_alert_batch(batch.filter(F.col("event") != "update"), path, batch_id)

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
