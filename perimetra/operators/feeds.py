"""Raw sensor feeds: packets to frames, health, gaps, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.functions.thermal import calibrated_c, linear_c
from perimetra.operators.scans import asof, chunked, numbered, running_max, running_sum
from perimetra.params import CALIBRATION, CHUNK_FRAMES, SENSOR, Calibration, Sensor

# Bits of a packet header.
FID, EOF, ERR = 0x01, 0x02, 0x40


def packet_frames(packets: DataFrame, s: Sensor = SENSOR, span: int | None = CHUNK_FRAMES, payload: bool = True) -> DataFrame:
    """Group packets ``(site_id, session, seq, header_len, flags, payload)`` into frames and class each.

    A frame ends at its end-of-frame packet, or is torn where the frame id flips first. The
    bytes of a good frame are joined in order; a frame has a bounded number of packets.
    """
    keys = ["site_id", "session"]
    c = F.col
    rows = packets.filter(F.length("payload") >= 2).withColumns(
        {
            "_fid": c("flags").bitwiseAND(F.lit(FID)),
            "_eof": c("flags").bitwiseAND(F.lit(EOF)) != 0,
            "_err": c("flags").bitwiseAND(F.lit(ERR)) != 0,
            "_body": F.greatest(F.length("payload") - c("header_len"), F.lit(0)),
        }
    )
    ch = chunked(rows, keys, ["seq"], depth=1, span=span)
    ch = ch.with_columns({"_was_eof": F.lag("_eof").over(ch.part), "_was_fid": F.lag("_fid").over(ch.part)})
    flip = (~F.coalesce(c("_was_eof"), F.lit(True))) & (c("_was_fid") != c("_fid"))
    rows = ch.with_columns({"_starts": (F.coalesce(c("_was_eof"), F.lit(True)) | flip).cast("int")}).finish("_was_eof", "_was_fid")
    ch = chunked(rows, keys, ["seq"], carry={"_n0": ("sum", c("_starts"))}, span=span)
    rows = ch.with_columns({"frame_no": running_sum(ch, "_n0", c("_starts"))}).finish("_n0", "_starts")
    size = F.sum("_body")
    aggs = [
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("packets"), size.alias("bytes"), F.count_if("_err").alias("errors"),
        F.max("_eof").alias("_ended"),
    ]
    if payload:
        body = F.expr("substring(payload, header_len + 1)")
        aggs.append(F.sort_array(F.collect_list(F.struct("seq", body.alias("b")))).alias("_parts"))
    frames = rows.groupBy(*keys, "frame_no").agg(*aggs)
    newest = rows.groupBy(*keys).agg(F.max("frame_no").alias("_newest"))
    frames = frames.join(newest, keys)
    extra = c("bytes") - s.frame_bytes
    state = (
        F.when(~c("_ended"), F.when(c("frame_no") == c("_newest"), "open").when(c("bytes") > 0, "torn").otherwise("empty"))
        .when(c("errors") > 0, "error")
        .when(extra < 0, "short")
        .when(extra > s.slack_bytes, "mismatched")
        .otherwise("good")
    )
    out = frames.withColumn("state", state)
    if payload:
        joined = F.aggregate(F.col("_parts.b"), F.lit(b""), lambda a, b: F.concat(a, b))
        out = out.withColumn("frame", F.when(F.col("state") == "good", F.substring(joined, 1, s.frame_bytes))).drop("_parts")
    return out.drop("_ended", "_newest")


def feed_health(frames: DataFrame) -> DataFrame:
    """Counts of each outcome and the share of good frames, per site. Every flagged packet counts as an error."""

    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    h = frames.groupBy("site_id").agg(
        n("good").alias("frames"), n("short").alias("short"), n("torn").alias("torn"), F.sum("errors").alias("errors"),
        n("mismatched").alias("mismatched"),
    )
    total = F.col("frames") + F.col("short") + F.col("torn") + F.col("errors") + F.col("mismatched")
    return h.withColumn("good_pct", F.bround(100.0 * F.col("frames") / F.nullif(total, F.lit(0)), 1))


def feed_gaps(arrivals: DataFrame, keys: list[str], s: Sensor = SENSOR, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Add ``gap_s`` since the feed's last frame and whether it had gone stale."""
    ch = chunked(arrivals, keys, ["frame_idx"], depth=1, span=span)
    out = ch.with_columns({"gap_s": (F.col("t_us") - F.lag("t_us").over(ch.part)) / 1e6}).finish()
    return out.withColumn("stale", F.coalesce(F.col("gap_s") >= s.stale_after_s, F.lit(False)))


def read_failures(reads: DataFrame, keys: list[str], s: Sensor = SENSOR, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Length of the run of failed reads at each row, and whether it is one to warn about."""
    placed = numbered(reads, keys, ["frame_idx"], "_i", span)
    good = F.when(F.col("ok"), F.col("_i"))
    ch = chunked(placed, keys, ["frame_idx"], carry={"_good": ("max", good)}, span=span)
    run = F.col("_i") - F.coalesce(running_max(ch, "_good", good), F.lit(0))
    out = ch.with_columns({"failures": run}).finish("_good", "_i")
    n = F.col("failures")
    again = (n > s.warn_after_failures) & (n % s.warn_every_failures == 0)
    return out.withColumn("warn", (n == s.warn_after_failures) | again)


def paired(optical: DataFrame, thermal: DataFrame, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Each optical frame with the newest thermal frame at its time; an old one is used again."""
    t = thermal.select("site_id", "t_us", F.col("frame_idx").alias("thermal_frame"))
    return asof(optical, t, ["site_id"], "t_us", "_t", span).select("*", F.col("_t.thermal_frame").alias("thermal_frame"),
        ((F.col("t_us") - F.col("_t.t_us")) / 1e6).alias("age_s")).drop("_t")


def probe(frames: DataFrame, every: str = "2 seconds", c: Calibration = CALIBRATION) -> DataFrame:
    """Reading of the hottest pixel per interval, one stage of the sum per column."""
    agg = frames.groupBy("site_id", F.window("ts", every).alias("w")).agg(
        F.min(F.array_min("counts")).alias("raw_min"),
        F.max(F.struct(F.array_max("counts").alias("raw"), F.col("ambient_c"))).alias("m"),
    )
    linear = linear_c(F.col("m.raw").cast("double"), F.col("m.ambient_c"), c)
    return agg.select(
        "site_id", F.col("w.start").alias("start"), F.col("m.ambient_c").alias("ambient_c"), "raw_min", F.col("m.raw").alias("raw_max"),
        linear.alias("linear_c"), calibrated_c(linear, c).alias("celsius"),
    )
