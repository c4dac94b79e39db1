"""Signal operators on level frames (session_id, source, frame, rms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions import scalars as X

SESSION = ("session_id",)


def rms_frames(samples: DataFrame, keys: Sequence[str], per_frame: int = 160) -> DataFrame:
    """Root mean square of each full frame of samples; non-finite counts as 0."""
    x = F.when(F.isnan("sample") | (F.abs("sample") == float("inf")), 0.0).otherwise(F.col("sample").cast("double"))
    return samples.groupBy(*keys, F.expr(f"pos DIV {per_frame}").alias("frame")).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.count(F.lit(1)).alias("n")).where(F.col("n") == per_frame).drop("n")


def level_buckets(samples: DataFrame, keys: Sequence[str], per_bucket: int = 800) -> DataFrame:
    """Peak and root mean square of each bucket, the last partial one too."""
    x = F.col("sample").cast("double")
    return samples.groupBy(*keys, F.expr(f"pos DIV {per_bucket}").alias("bucket")).agg(F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"))


def activity_threshold(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A tenth of the 95th percentile (rank ceil), 0.0001 at least; null for silence."""
    p = frames.groupBy(*keys).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY rms)").alias("p95"))
    return p.withColumn("threshold", F.when(F.col("p95") > 1e-5, F.greatest(F.col("p95") * 0.1, F.lit(1e-4))))


def paired(frames: DataFrame, lag: Column | int = 0) -> DataFrame:
    """(session_id, frame, mic, system): microphone frames beside system frames ``lag`` earlier."""
    mic = frames.where("source = 'mic'").select("session_id", "frame", F.col("rms").alias("mic"))
    system = frames.where("source = 'system'").select("session_id", (F.col("frame") + lag).alias("frame"), F.col("rms").alias("system"))
    return mic.join(system, ["session_id", "frame"])


def lag_correlations(frames: DataFrame, lags: Sequence[int], least: int = 20) -> DataFrame:
    """Correlation of log levels for each lag with pairs enough; null where a side is flat."""
    mic = frames.where("source = 'mic'").select("session_id", "frame", F.col("rms").alias("mic"))
    system = frames.where("source = 'system'").select("session_id", F.explode(F.array(*map(F.lit, lags))).alias("lag"), "frame", F.col("rms").alias("system")).withColumn("frame", F.col("frame") + F.col("lag"))
    pairs = mic.join(system, ["session_id", "frame"])
    ln = lambda c: F.log(F.col(c) + 1e-6)
    found = pairs.groupBy("session_id", "lag").agg(F.corr(ln("mic"), ln("system")).alias("r"), F.count(F.lit(1)).alias("n"), F.avg(F.log(F.greatest("mic", F.lit(1e-6))) - F.log(F.greatest("system", F.lit(1e-6)))).alias("gain_ln")).where(F.col("n") >= least)
    return found.withColumn("r", F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.0)))


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag of the highest correlation, the largest of equals, and the earliest within 0.02 of it."""
    w = Window.partitionBy("session_id")
    rated = correlations.where("r IS NOT NULL").withColumn("_top", F.max("r").over(w))
    return rated.groupBy("session_id").agg(F.max_by("lag", F.struct("r", "lag")).alias("best_lag"), F.max("r").alias("r"), F.min(F.when(F.col("r") >= F.col("_top") - 0.02, F.col("lag"))).alias("earliest_lag"))


def room_tail(frames: DataFrame, keys: Sequence[str], level: str = "rms", tail: int = 15, decay: float = 0.7) -> DataFrame:
    """Each frame held by the decaying levels of the frames before it; missing frames are silent."""
    spread = frames.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(tail))).alias("_k"), "frame", F.col(level).alias("_l")).select(*keys, (F.col("frame") + F.col("_k")).alias("frame"), (F.col("_l") * F.pow(F.lit(decay), F.col("_k"))).alias("held"))
    held = spread.groupBy(*keys, "frame").agg(F.max("held").alias("held"))
    return frames.select(*keys, "frame").join(held, [*keys, "frame"])


def leak_gains(ratios: DataFrame, step: int = 500, half: int = 6000, least: int = 200, q: float = 0.2) -> DataFrame:
    """The floor-index quantile of the ratios around each step, the session's where there are too few."""
    whole = ratios.groupBy("session_id").agg(X.floor_quantile(F.collect_list("ratio"), q).alias("overall"), F.max("frame").alias("last"))
    steps = whole.withColumn("start", F.explode(F.expr(f"sequence(0L, last, {step})"))).drop("last")
    spread = ratios.withColumn("start", F.explode(F.expr(f"sequence(greatest(0L, ((frame - {half}) DIV {step}) * {step}), ((frame + {half}) DIV {step}) * {step}, {step})"))).where(f"frame >= greatest(start - {half}, 0) AND frame < start + {half}")
    local = spread.groupBy("session_id", "start").agg(X.floor_quantile(F.collect_list("ratio"), q).alias("_local"), F.count(F.lit(1)).alias("n"))
    return steps.join(local, ["session_id", "start"], "left").select("session_id", "start", F.when(F.col("n") >= least, F.col("_local")).otherwise(F.col("overall")).alias("gain"))


def frame_lead(frames: DataFrame, delay: int, active: float, gain: float, noise: float, excess_db: float = 8.0, over_noise: float = 3.0) -> DataFrame:
    """Who leads each microphone frame: mic, system, both or nobody, against the delayed and held system level."""
    system = frames.where("source = 'system'").select("session_id", (F.col("frame") + delay).alias("frame"), "rms")
    mic = frames.where("source = 'mic'").select("session_id", "frame", F.col("rms").alias("mic"))
    held = room_tail(system.unionByName(mic.select("session_id", "frame", F.lit(0.0).alias("rms"))).groupBy("session_id", "frame").agg(F.max("rms").alias("rms")), SESSION)
    both = mic.join(held, ["session_id", "frame"])
    is_active = F.col("held") >= active
    leads = (F.col("mic") > over_noise * noise) & (F.col("mic") >= 10 ** (excess_db / 20) * (gain * F.col("held") + noise))
    return both.withColumn("lead", F.when(leads & is_active, "both").when(leads, "mic").when(is_active, "system"))


def lead_majority(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both if as common as either side, mic only if more common than system, null without any."""
    c = rows.groupBy(*keys).agg(*[F.count_if(F.col("lead") == x).alias(x) for x in ("mic", "system", "both")])
    none = F.col("mic") + F.col("system") + F.col("both") == 0
    return c.withColumn("lead", F.when(none, None).when((F.col("both") >= F.col("mic")) & (F.col("both") >= F.col("system")), "both").when(F.col("mic") > F.col("system"), "mic").otherwise("system"))


def calibration_windows(pairs: DataFrame, width: int = 200, threshold: float = 0.01, least_r: float = 0.8) -> DataFrame:
    """Tumbling windows of which half is active, with their correlation; ``kept`` if it is high."""
    ln = lambda c: F.log(F.col(c) + 1e-6)
    w = pairs.groupBy("session_id", F.expr(f"frame DIV {width}").alias("win")).agg(F.count_if(F.col("system") >= threshold).alias("active"), F.count(F.lit(1)).alias("n"), F.corr(ln("mic"), ln("system")).alias("r"))
    return w.withColumn("kept", F.coalesce((F.col("active") * 2 >= F.col("n")) & (F.col("r") >= least_r), F.lit(False)))


def word_leads(words: DataFrame, leads: DataFrame, frame_ms: int = 10) -> DataFrame:
    """Frames of each lead within each word; frames meet words by their number."""
    spread = words.withColumn("frame", F.explode(F.expr(f"sequence(start_ms DIV {frame_ms}, greatest(start_ms, end_ms - 1) DIV {frame_ms})")))
    met = spread.join(leads.select("session_id", "frame", "lead"), ["session_id", "frame"])
    return lead_majority(met, ("session_id", "word_id"))


def nearest_point(frames: DataFrame, points: DataFrame, horizon: int, fallback: int) -> DataFrame:
    """The value of the nearest point within the horizon, the earlier of equals, else the fallback.

    Of points at one place the smallest delay counts, for the frames before it and after it.
    """
    points = points.groupBy("session_id", "at").agg(F.min("delay").alias("delay"))
    both = frames.select("session_id", "frame", F.lit(None).cast("struct<at:bigint,delay:int>").alias("p")).unionByName(points.select("session_id", F.col("at").alias("frame"), F.struct(F.col("at").cast("long").alias("at"), F.col("delay").cast("int").alias("delay")).alias("p")))
    w = Window.partitionBy("session_id").orderBy("frame")
    near = both.withColumn("_a", F.last("p", True).over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("_b", F.first("p", True).over(w.rangeBetween(0, Window.unboundedFollowing))).where("p IS NULL")
    da, db = F.col("frame") - F.col("_a.at"), F.col("_b.at") - F.col("frame")
    a_ok, b_ok = F.coalesce(da <= horizon, F.lit(False)), F.coalesce(db <= horizon, F.lit(False))
    return near.select("session_id", "frame", F.when(a_ok & (~b_ok | (da <= db)), F.col("_a.delay")).when(b_ok, F.col("_b.delay")).otherwise(fallback).alias("delay"))


def mix_tracks(frames: DataFrame) -> DataFrame:
    """The sum of the tracks, clamped to [-1, 1]; a track without a frame is silent."""
    return frames.groupBy("session_id", "frame").agg(F.least(F.greatest(F.sum("rms"), F.lit(-1.0)), F.lit(1.0)).alias("mixed"))


def joined_envelope(levels: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pieces' level buckets (*keys, piece, bucket, peak) at their places (*keys, piece, offset, buckets), silence elsewhere.

    The envelope reaches to the end of the last piece; where pieces overlap the
    louder counts, and buckets beyond a piece's own number aren't its.
    """
    placed = levels.join(pieces, [*keys, "piece"]).where("bucket >= 0 AND bucket < buckets").groupBy(*keys, (F.col("offset") + F.col("bucket")).alias("bucket")).agg(F.max("peak").alias("peak"))
    whole = pieces.groupBy(*keys).agg(F.max(F.col("offset") + F.col("buckets")).alias("_n")).where("_n > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("bucket"))
    return whole.join(placed, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("peak", F.lit(0.0)).alias("peak"))
