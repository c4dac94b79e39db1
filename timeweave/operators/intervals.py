"""Interval joins, overlays and set algebra over (session_id, source, start_ms, end_ms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session_id", "source")
#: Width of the time buckets on which range joins meet.
BUCKET_MS = 10_000


def midpoint(start: str = "start_ms", end: str = "end_ms") -> Column:
    """start + (end - start) div 2, an end before the start counting as the start (F8)."""
    return F.expr(f"{start} + greatest({end} - {start}, 0) DIV 2")


def range_join(left: DataFrame, right: DataFrame, left_range: tuple[Column, Column], right_range: tuple[Column, Column], keys: Sequence[str] = KEYS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs with equal keys whose closed ranges meet; right columns get the prefix ``r_``.

    Both sides are dealt to the time buckets that they touch, so rows meet by
    equality on (keys, bucket) and a dense session is spread over many tasks. A
    pair is given only in the bucket where the later of both starts.
    """
    a = left.withColumn("_lo", left_range[0]).withColumn("_hi", F.greatest(left_range[1], F.col("_lo")))
    b = right.withColumn("_rlo", right_range[0]).withColumn("_rhi", F.greatest(right_range[1], F.col("_rlo")))
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], "_rlo", "_rhi")
    split = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor(F.col(hi) / bucket_ms)))
    a, b = a.withColumn("_bucket", split("_lo", "_hi")), b.withColumn("_rbucket", split("_rlo", "_rhi"))
    on = [F.col(k) == F.col(f"r_{k}") for k in keys] + [F.col("_bucket") == F.col("_rbucket"), F.col("_lo") <= F.col("_rhi"), F.col("_rlo") <= F.col("_hi")]
    met = a.join(b, on).where(F.col("_bucket") == F.floor(F.greatest("_lo", "_rlo") / bucket_ms))
    return met.drop("_lo", "_hi", "_bucket", "_rlo", "_rhi", "_rbucket", *[f"r_{k}" for k in keys])


def overlap_ms(a_start: str = "start_ms", a_end: str = "end_ms", b_start: str = "r_start_ms", b_end: str = "r_end_ms") -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def assign_cluster(words: DataFrame, segments: DataFrame, tolerance_ms: int = 500) -> DataFrame:
    """Each word with the cluster of the segment that overlaps it most, else of the nearest within tolerance, else null.

    Equal overlaps go to the first segment by (start, cluster); equal distances
    to the smaller start, then cluster. The best candidate is a ``min`` of a
    struct, so it is aggregated before the shuffle.
    """
    met = range_join(words, segments, (F.col("start_ms") - tolerance_ms, F.col("end_ms") + tolerance_ms), (F.col("start_ms"), F.col("end_ms")))
    overlap = overlap_ms()
    distance = F.when(F.col("end_ms") <= F.col("r_start_ms"), F.col("r_start_ms") - F.col("end_ms")).when(F.col("r_end_ms") <= F.col("start_ms"), F.col("start_ms") - F.col("r_end_ms")).otherwise(0)
    rated = met.withColumn("_o", overlap).withColumn("_d", distance).where((F.col("_o") > 0) | (F.col("_d") <= tolerance_ms))
    order = F.struct(F.when(F.col("_o") > 0, 0).otherwise(1).alias("kind"), F.when(F.col("_o") > 0, -F.col("_o")).otherwise(F.col("_d")).alias("by"), F.col("r_start_ms"), F.col("r_cluster"))
    best = rated.groupBy("session_id", "source", "word_id").agg(F.min(order).alias("_best"))
    return words.join(best, ["session_id", "source", "word_id"], "left").withColumn("cluster", F.col("_best.r_cluster")).drop("_best")


def anonymous_names(segments: DataFrame, recognized: DataFrame | None = None) -> DataFrame:
    """SPEAKER_00, 01, .. by first appearance (start, mic before system, cluster), recognized clusters left out."""
    first = segments.groupBy("session_id", "source", "cluster").agg(F.min("start_ms").alias("first_ms"))
    if recognized is not None:
        first = first.join(recognized.select("session_id", "source", "cluster"), ["session_id", "source", "cluster"], "left_anti")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("first_ms", F.when(F.col("source") == "mic", 0).otherwise(1), "cluster")) - 1
    return first.withColumn("name", F.concat(F.lit("SPEAKER_"), F.lpad(number.cast("string"), 2, "0"))).select("session_id", "source", "cluster", "first_ms", "name")


def name_words(words: DataFrame, names: DataFrame) -> DataFrame:
    """Names by (session, source, cluster); ``unknown`` without a cluster."""
    return words.join(names.select("session_id", "source", "cluster", "name"), ["session_id", "source", "cluster"], "left").withColumn("name", F.coalesce("name", F.lit("unknown")))


def frequent_speakers(rows: DataFrame, n: int, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """The ``n`` speakers of each session with most time, by (time desc, name)."""
    totals = rows.groupBy(*by, "name").agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("talk_ms"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("talk_ms").desc(), "name"))
    return totals.withColumn("rank", rank).where(F.col("rank") <= n)


def overlay_corrections(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """The correction whose closed range holds a word's midpoint; locks before inferred, the newest of equals."""
    mid = midpoint()
    met = range_join(words, corrections, (mid, mid), (F.col("start_ms"), F.col("end_ms")))
    newest = F.min_by(F.struct("r_speaker", (~F.col("r_inferred")).alias("locked")), F.struct(F.col("r_inferred").cast("int"), -F.col("r_ordinal")))
    best = met.groupBy("session_id", "source", "word_id").agg(newest.alias("_c"))
    return words.join(best, ["session_id", "source", "word_id"], "left").withColumn("speaker", F.col("_c.r_speaker")).withColumn("locked", F.coalesce(F.col("_c.locked"), F.lit(False))).drop("_c")


def overlay_turns(words: DataFrame, turns: DataFrame) -> DataFrame:
    """The first group whose closed range holds the midpoint, and its last turn that starts by the word's start, else the first."""
    mid = midpoint()
    met = range_join(words, turns, (mid, mid), (F.col("start_ms"), F.col("end_ms")))
    begun = F.col("r_turn_ms") <= F.col("start_ms")
    pick = F.min_by(F.struct("r_group_id", "r_turn", "r_speaker"), F.struct(F.col("r_start_ms"), F.col("r_group_id"), F.when(begun, 0).otherwise(1), F.when(begun, -F.col("r_turn_ms")).otherwise(F.col("r_turn_ms"))))
    best = met.groupBy("session_id", "source", "word_id").agg(pick.alias("_t"))
    return words.join(best, ["session_id", "source", "word_id"]).select("session_id", "source", "word_id", F.col("_t.r_group_id").alias("group_id"), F.col("_t.r_turn").alias("turn"), F.col("_t.r_speaker").alias("speaker"), F.col("_t.r_speaker").isNotNull().alias("locked"))


def in_any_range(rows: DataFrame, ranges: DataFrame, at: Column | None = None) -> DataFrame:
    """The rows whose midpoint (or ``at``) lies in some closed range of their source."""
    at = midpoint() if at is None else at
    own = rows.columns
    return range_join(rows, ranges.select(*KEYS, "start_ms", "end_ms"), (at, at), (F.col("start_ms"), F.col("end_ms"))).select(*own).distinct()


def merge_intervals(rows: DataFrame, keys: Sequence[str] = KEYS, gap_ms: int = 0) -> DataFrame:
    """Unions of intervals that touch or overlap (or are ``gap_ms`` apart)."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start_ms") > reach + gap_ms), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("_island")


def subtract(rows: DataFrame, cuts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Closed ranges of one cut each minus the cut, which leaves up to two ranges one millisecond beside it."""
    met = rows.join(cuts.select(*keys, F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end")), list(keys))
    apart = (F.col("c_end") < F.col("start_ms")) | (F.col("c_start") > F.col("end_ms"))
    whole = F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    before = F.struct(F.col("start_ms").alias("s"), (F.col("c_start") - 1).alias("e"))
    after = F.struct((F.col("c_end") + 1).alias("s"), F.col("end_ms").alias("e"))
    parts = F.when(apart, F.array(whole)).otherwise(F.filter(F.array(before, after), lambda x: x["s"] <= x["e"]))
    return met.withColumn("_p", F.explode(parts)).select(*[c for c in rows.columns if c not in ("start_ms", "end_ms")], F.col("_p.s").alias("start_ms"), F.col("_p.e").alias("end_ms"))


def overlap_sweep(bars: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Stretches in which two lanes and more speak, named by the two lowest, neighbours of one pair joined."""
    lanes = bars.where("end_ms > start_ms").select(*keys, "lane", "start_ms", "end_ms").distinct()
    edges = lanes.select(*keys, F.col("start_ms").alias("at")).union(lanes.select(*keys, F.col("end_ms").alias("at"))).distinct()
    order = Window.partitionBy(*keys).orderBy("at")
    cells = edges.withColumn("to", F.lead("at").over(order)).where("to IS NOT NULL").withColumnRenamed("at", "start_ms").withColumnRenamed("to", "end_ms")
    met = range_join(cells, lanes, (F.col("start_ms"), F.col("end_ms") - 1), (F.col("start_ms"), F.col("end_ms") - 1), keys=keys).where("r_start_ms <= start_ms AND r_end_ms >= end_ms")
    pairs = met.groupBy(*keys, "start_ms", "end_ms").agg(F.sort_array(F.collect_set("r_lane")).alias("l")).where(F.size("l") >= 2).select(*keys, "start_ms", "end_ms", F.col("l")[0].alias("lane_a"), F.col("l")[1].alias("lane_b"))
    w = Window.partitionBy(*keys).orderBy("start_ms")
    same = (F.lag("end_ms").over(w) == F.col("start_ms")) & (F.lag("lane_a").over(w) == F.col("lane_a")) & (F.lag("lane_b").over(w) == F.col("lane_b"))
    runs = pairs.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("lane_a").alias("lane_a"), F.first("lane_b").alias("lane_b")).drop("_run")


def name_by_overlap(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """Each segment under the name of the line with the largest overlap, the last of equals, else ``spk_N`` / ``mic_N``."""
    met = range_join(segments, lines, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), F.col("end_ms"))).withColumn("_o", overlap_ms()).where("_o > 0")
    best = met.groupBy("session_id", "source", "seg_id").agg(F.max_by("r_speaker", F.struct("_o", "r_ordinal")).alias("_name"))
    fallback = F.concat(F.when(F.col("source") == "mic", "mic_").otherwise("spk_"), F.col("cluster").cast("string"))
    return segments.join(best, ["session_id", "source", "seg_id"], "left").withColumn("label", F.coalesce("_name", fallback)).drop("_name")


def clip_words(words: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Words whose midpoint is in [start, end), on the clip's axis, rounded to 10 ms, 10 ms long at least."""
    rounded = lambda c: F.expr(f"(({c}) + 5) DIV 10 * 10")
    inside = words.where((midpoint() >= start_ms) & (midpoint() < end_ms))
    moved = inside.withColumn("clip_start", rounded(f"greatest(start_ms - {start_ms}, 0)")).withColumn("_e", rounded(f"least(greatest(end_ms - {start_ms}, 0), {end_ms - start_ms})"))
    return moved.withColumn("clip_end", F.greatest(F.col("_e"), F.col("clip_start") + 10)).drop("_e")


def recording_overlaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of recordings whose half-open stretches share time."""
    met = range_join(rows, rows, (F.col("start_ms"), F.col("end_ms") - 1), (F.col("start_ms"), F.col("end_ms") - 1), keys=keys)
    return met.where("rec_id < r_rec_id AND start_ms < r_end_ms AND r_start_ms < end_ms").select(*keys, F.col("rec_id").alias("a"), F.col("r_rec_id").alias("b")).distinct()


def other_voice_chunks(chunks: DataFrame, least_ms: int = 200) -> DataFrame:
    """Chunks with ``crowded``: other clusters of the source speak for ``least_ms`` in them, unless all of the cluster's do."""
    met = range_join(chunks, chunks, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), F.col("end_ms"))).where("cluster <> r_cluster")
    others = met.groupBy("session_id", "source", "seg_id").agg(F.sum(overlap_ms()).alias("other_ms"))
    rated = chunks.join(others, ["session_id", "source", "seg_id"], "left").withColumn("other_ms", F.coalesce("other_ms", F.lit(0))).withColumn("_c", F.col("other_ms") >= least_ms)
    all_crowded = F.min(F.col("_c").cast("int")).over(Window.partitionBy("session_id", "source", "cluster")) == 1
    return rated.withColumn("crowded", F.col("_c")).withColumn("used", ~F.col("_c") | all_crowded).drop("_c")


def learnable(chunks: DataFrame, lines: DataFrame, cuts: DataFrame, least_ms: int = 1500) -> DataFrame:
    """Chunks of 1.5 s and more, half of which lies in a line, that don't reach into a cut group."""
    long = chunks.where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    met = range_join(long, lines, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), F.col("end_ms"))).withColumn("_o", overlap_ms())
    half = met.where(F.col("_o") * 2 >= F.col("end_ms") - F.col("start_ms")).select("session_id", "source", "seg_id", F.col("r_line_id").alias("line_id"), "start_ms", "end_ms").distinct()
    cut = range_join(long, cuts, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), F.col("end_ms"))).where("start_ms < r_end_ms AND r_start_ms < end_ms").select("session_id", "source", "seg_id").distinct()
    return half.join(cut, ["session_id", "source", "seg_id"], "left_anti")
