"""Operators on sessions, meetings, people and their files: matching, names, splits and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions import scalars as X
from timeweave.operators.intervals import merge_intervals, range_join
from timeweave.session import stored


def calendar_match(sessions: DataFrame, meetings: DataFrame, keys: Sequence[str] = (), early_s: int = 900, late_s: int = 600) -> DataFrame:
    """Meetings that a recording starts near or overlaps, ranked by shared share, then distance.

    The share is overlap / (recorded + meeting - overlap); it is compared as an
    exact decimal ratio. Equal titles and starts count once. Both sides meet in
    buckets of a day.
    """
    s = sessions.withColumn("start_ms", F.col("start_s")).withColumn("end_ms", F.col("end_s"))
    m = meetings.dropDuplicates([*keys, "title", "start_s"]).withColumn("start_ms", F.col("start_s")).withColumn("end_ms", F.col("end_s"))
    met = range_join(s, m, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms") - early_s, F.col("end_ms") + late_s), keys=keys, bucket_ms=86_400)
    overlap = F.greatest(F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s"), F.lit(0))
    near = (F.col("start_s") >= F.col("r_start_s") - early_s) & (F.col("start_s") <= F.col("r_end_s") + late_s)
    rated = met.withColumn("overlap_s", overlap).where(near | (F.col("overlap_s") > 0))
    rated = rated.withColumn("union_s", F.greatest(F.col("end_s") - F.col("start_s") + F.col("r_end_s") - F.col("r_start_s") - F.col("overlap_s"), F.lit(1)))
    share = F.col("overlap_s").cast("decimal(18,0)") / F.col("union_s").cast("decimal(18,0)")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(share.desc(), F.abs(F.col("start_s") - F.col("r_start_s")), "r_meeting_id"))
    return rated.withColumn("rank", rank).select("session_id", F.col("r_meeting_id").alias("meeting_id"), "overlap_s", "union_s", "rank")


def dedupe_names(rows: DataFrame, keys: Sequence[str], name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """Trimmed non-empty names, the first of equal keys."""
    fine = rows.withColumn(name, F.trim(name)).where(F.col(name) != "")
    first = F.row_number().over(Window.partitionBy(*keys, X.name_key(F.col(name))).orderBy(ordinal))
    return fine.withColumn("_r", first).where("_r = 1").drop("_r")


def merge_people(samples: DataFrame) -> DataFrame:
    """People of one key become one, under the spelling with most samples, the smaller of equals."""
    counts = samples.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("key", X.name_key(F.col("name")))
    named = counts.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("merged"), F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_spellings"))
    return named


def suggestions(names: DataFrame, typed: str, most: int = 8) -> DataFrame:
    """Names by how they match what was typed: exact, prefix, contained; then by name."""
    key, want = X.name_key(F.col("name")), typed.strip().lower()
    rank = F.when(key == want, 0).when(key.startswith(want), 1).when(key.contains(want), 2)
    return names.withColumn("match", rank).where("match IS NOT NULL").orderBy("match", "name").limit(most)


def sessions_by_day(sessions: DataFrame, offset_minutes: Column | int = 0) -> DataFrame:
    """Sessions of each local day, in order of their start, and the statuses that occur."""
    day = F.expr("floor(start_s / 60)") + offset_minutes
    rows = sessions.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(day / 1440).cast("int")))
    return rows.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "session_id"))), lambda s: s["session_id"]).alias("sessions"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))


def week_headings(days: DataFrame) -> DataFrame:
    """The Monday of each row's week where it differs from that of the row before."""
    week = F.date_trunc("week", F.col("day").cast("timestamp")).cast("date")
    first = F.row_number().over(Window.partitionBy("week").orderBy("day")) == 1
    return days.withColumn("week", week).withColumn("heading", F.when(first, F.col("week")))


def split_rows(rows: DataFrame, at: int, column: str = "start_ms", also: Sequence[str] = ()) -> DataFrame:
    """Rows of the first part (before ``at``) and the second, whose times start anew."""
    part = F.when(F.col(column) < at, 0).otherwise(1)
    shifted = rows.withColumn("part", part)
    for c in (column, *also):
        shifted = shifted.withColumn(c, F.when(F.col("part") == 1, F.greatest(F.col(c) - at, F.lit(0))).otherwise(F.col(c)))
    return shifted


def split_ranges(ranges: DataFrame, at: int) -> DataFrame:
    """Ranges clipped to each part, empty ones left out."""
    both = ranges.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    start = F.when(F.col("part") == 0, F.col("start_ms")).otherwise(F.greatest(F.col("start_ms") - at, F.lit(0)))
    end = F.when(F.col("part") == 0, F.least(F.col("end_ms"), F.lit(at))).otherwise(F.col("end_ms") - at)
    return both.withColumn("_s", start).withColumn("end_ms", end).withColumn("start_ms", F.col("_s")).drop("_s").where("end_ms > start_ms")


def join_rows(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("start_ms", "end_ms")) -> DataFrame:
    """Rows of pieces moved to their place in the whole."""
    met = rows.join(offsets, list(keys))
    for c in columns:
        met = met.withColumn(c, F.col(c) + F.col("offset_ms"))
    return met.drop("offset_ms")


def join_spans(spans: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first piece's start and the last piece's end."""
    return spans.groupBy(*keys).agg(F.min_by("start_ms", order).alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"))


def keep_rules(ranges: DataFrame, added: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added ranges in, equal ranges out, then normalised."""
    both = ranges.select(*keys, "start_ms", "end_ms").unionByName(added.select(*keys, "start_ms", "end_ms"))
    left = both.join(removed.select(*keys, "start_ms", "end_ms"), [*keys, "start_ms", "end_ms"], "left_anti")
    return merge_intervals(left, keys, gap_ms=1).drop("n")


def ancestors(links: DataFrame, most: int = 16) -> DataFrame:
    """(child, ancestor, hops) along parent links, at most ``most`` hops; cycles end there.

    Each hop is a join of the one before with the links, so that neither rows nor
    plans have a bound.
    """
    level = stored(links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("hops")), "ancestors")
    up, found = links.select(F.col("child").alias("ancestor"), "parent"), level
    for hops in range(2, most + 1):
        level = stored(level.join(up, "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(hops).alias("hops")), "ancestors")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def session_status(rows: DataFrame) -> DataFrame:
    """P10: recording, archived, recorded, done, processed, the first that holds."""
    return rows.withColumn("status", F.when(F.col("recording"), "recording").when(F.col("archived"), "archived").when(~F.col("transcribed"), "recorded").when(F.col("done"), "done").otherwise("processed"))


def refusal(rows: DataFrame, reasons: Sequence[tuple[Column, str]]) -> DataFrame:
    """The first reason that holds, else null."""
    return rows.withColumn("refusal", F.coalesce(*[F.when(c, text) for c, text in reasons]))


def speaker_id(ids: Column) -> tuple[Column, Column]:
    """Source and cluster of ``spk_N`` and ``mic_N``; nulls for anything else."""
    number = F.regexp_extract(ids, r"^(spk|mic)_(\d{1,9})$", 2).try_cast("int")
    return F.when(number.isNotNull(), F.when(ids.startswith("mic_"), "mic").otherwise("system")), number


def transcript_lines(rows: DataFrame) -> DataFrame:
    """``[hh:mm:ss.mmm] name[ [echo]]: text``."""
    return rows.withColumn("line", F.concat(F.lit("["), X.format_timestamp(F.col("start_ms")), F.lit("] "), "speaker", F.when(F.col("echo"), " [echo]").otherwise(""), F.lit(": "), "text"))


def provenance(rows: DataFrame, recorded: DataFrame, key: str = "artifact") -> DataFrame:
    """What was recorded of each artifact beside its present hash; ``stale`` where they differ."""
    now = rows.groupBy(key).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("content"))), 256).alias("sha256"))
    return now.join(recorded.withColumnRenamed("sha256", "recorded"), key, "left").withColumn("stale", F.col("recorded").isNull() | (F.col("recorded") != F.col("sha256")))


def fold_groups(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns of a group as one line: span, text in order, all locked, all echo."""
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "line_id", "text")))
    return lines.groupBy(*keys, "group_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"), F.bool_and("locked").alias("locked"), F.bool_and("echo").alias("echo"))


def person_colors(rows: DataFrame) -> DataFrame:
    """Each person's most common colour, the lower number of equals."""
    counted = rows.groupBy("name", "color").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("name").agg(F.min_by("color", F.struct(-F.col("n"), F.col("color"))).alias("color"))


def upsert_learned(stored: DataFrame, new: DataFrame, threshold: float = 0.999) -> DataFrame:
    """New samples whose person has no equal vector stored, nor an earlier equal one among the new.

    A number may occur several times, among the new and the stored; each row is
    judged by its own number and vector.
    """
    from timeweave.operators.vectors import near_duplicates

    row = lambda side: F.struct(F.lit(side).alias("side"), "sample_no", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    asked = new.select(row("new").alias("id"), "v")
    known = near_duplicates(asked, stored.select(row("stored").alias("id"), "v"), threshold).select("a")
    again = near_duplicates(asked, asked, threshold).where("b.sample_no < a.sample_no").select("a")
    return new.withColumn("a", row("new")).join(known.unionByName(again).distinct(), "a", "left_anti").drop("a")
