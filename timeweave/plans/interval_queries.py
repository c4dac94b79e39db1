"""Queries of the interval operators, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import intervals as I
from timeweave.plans.catalogue import query
from timeweave.sources import tables as T

W, S = T.WORDS_SQL, T.SEGMENTS_SQL
_MID = "({a}start_ms + greatest({a}end_ms - {a}start_ms, 0) // 2)"


def _mid(a: str = "w.") -> str:
    return _MID.format(a=a)


ASSIGNED_SQL = """cand AS (
  SELECT w.session_id, w.source, w.word_id, s.cluster, s.start_ms AS s0,
         greatest(least(w.end_ms, s.end_ms) - greatest(w.start_ms, s.start_ms), 0) AS o,
         CASE WHEN w.end_ms <= s.start_ms THEN s.start_ms - w.end_ms WHEN s.end_ms <= w.start_ms THEN w.start_ms - s.end_ms ELSE 0 END AS d
  FROM words w JOIN segments s USING (session_id, source)),
picked AS (SELECT session_id, source, word_id, cluster FROM cand WHERE o > 0 OR d <= 500
  QUALIFY row_number() OVER (PARTITION BY session_id, source, word_id ORDER BY o > 0 DESC, CASE WHEN o > 0 THEN -o ELSE d END, s0, cluster) = 1),
assigned AS (SELECT w.*, p.cluster FROM words w LEFT JOIN picked p USING (session_id, source, word_id))"""
NAMES_SQL = """first AS (SELECT session_id, source, cluster, min(start_ms) AS first_ms FROM segments GROUP BY ALL),
names AS (SELECT *, 'SPEAKER_' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY first_ms, source, cluster) - 1 AS VARCHAR), 2, '0') AS name FROM first)"""


@query("assign_cluster", T.sql(W, S, ASSIGNED_SQL, body="SELECT session_id, source, word_id, start_ms, end_ms, text, cluster FROM assigned"))
def assign_cluster(spark, sf_dir):
    return I.assign_cluster(T.words(spark, sf_dir), T.segments(spark, sf_dir)).select("session_id", "source", "word_id", "start_ms", "end_ms", "text", "cluster")


@query("anonymous_names", T.sql(S, NAMES_SQL, body="SELECT session_id, source, cluster, first_ms, name FROM names"))
def anonymous_names(spark, sf_dir):
    return I.anonymous_names(T.segments(spark, sf_dir))


@query("speaker_talk_time", T.sql(W, S, ASSIGNED_SQL, NAMES_SQL, body="""
SELECT session_id, name, talk_ms, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY talk_ms DESC, name) AS INTEGER) AS rank FROM (
    SELECT a.session_id, coalesce(n.name, 'unknown') AS name, CAST(sum(greatest(a.end_ms - a.start_ms, 0)) AS BIGINT) AS talk_ms
    FROM assigned a LEFT JOIN names n USING (session_id, source, cluster) GROUP BY ALL)) WHERE rank <= 4"""))
def speaker_talk_time(spark, sf_dir):
    segments = T.segments(spark, sf_dir)
    named = I.name_words(I.assign_cluster(T.words(spark, sf_dir), segments), I.anonymous_names(segments))
    return I.frequent_speakers(named, 4)


@query("correction_overlay", T.sql(W, T.CORRECTIONS_SQL, body=f"""
SELECT w.session_id, w.source, w.word_id, c.speaker, coalesce(NOT c.inferred, false) AS locked FROM words w LEFT JOIN (
  SELECT w.session_id, w.source, w.word_id, c.speaker, c.inferred FROM words w JOIN corrections c USING (session_id, source)
  WHERE {_mid()} BETWEEN c.start_ms AND c.end_ms
  QUALIFY row_number() OVER (PARTITION BY w.session_id, w.source, w.word_id ORDER BY c.inferred, c.ordinal DESC) = 1) c USING (session_id, source, word_id)"""))
def correction_overlay(spark, sf_dir):
    return I.overlay_corrections(T.words(spark, sf_dir), T.corrections(spark, sf_dir)).select("session_id", "source", "word_id", "speaker", "locked")


@query("turn_overlay", T.sql(W, T.TURNS_SQL, body=f"""
SELECT session_id, source, word_id, group_id, turn, speaker, speaker IS NOT NULL AS locked FROM (
  SELECT w.session_id, w.source, w.word_id, t.group_id, t.turn, t.speaker FROM words w JOIN turns t USING (session_id, source)
  WHERE {_mid()} BETWEEN t.start_ms AND t.end_ms
  QUALIFY row_number() OVER (PARTITION BY w.session_id, w.source, w.word_id ORDER BY t.start_ms, t.group_id, t.turn_ms > w.start_ms, CASE WHEN t.turn_ms <= w.start_ms THEN -t.turn_ms ELSE t.turn_ms END) = 1)"""))
def turn_overlay(spark, sf_dir):
    return I.overlay_turns(T.words(spark, sf_dir), T.turns(spark, sf_dir))


@query("kept_words", T.sql(W, T.KEPT_SQL, body=f"SELECT w.* FROM words w WHERE EXISTS (SELECT 1 FROM kept k WHERE k.session_id = w.session_id AND k.source = w.source AND {_mid()} BETWEEN k.start_ms AND k.end_ms)"))
def kept_words(spark, sf_dir):
    return I.in_any_range(T.words(spark, sf_dir), T.kept_ranges(spark, sf_dir))


@query("merged_intervals", T.sql(S, body="""
SELECT session_id, source, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM segments))
GROUP BY session_id, source, island"""))
def merged_intervals(spark, sf_dir):
    return I.merge_intervals(T.segments(spark, sf_dir))


@query("kept_range_normalization", T.sql(T.KEPT_SQL, body="""
SELECT session_id, source, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_ms <= 1 + max(end_ms) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM kept))
GROUP BY session_id, source, island"""))
def kept_range_normalization(spark, sf_dir):
    return I.merge_intervals(T.kept_ranges(spark, sf_dir), gap_ms=1)


@query("lane_merge", T.sql(S, body="""
, clipped AS (SELECT session_id, cluster, greatest(start_ms, 100000) AS start_ms, least(end_ms, 2000000) AS end_ms FROM segments WHERE greatest(start_ms, 100000) < least(end_ms, 2000000))
SELECT session_id, cluster, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id, cluster ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY session_id, cluster ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM clipped))
GROUP BY session_id, cluster, island"""))
def lane_merge(spark, sf_dir):
    clipped = T.segments(spark, sf_dir).select("session_id", "cluster", F.greatest("start_ms", F.lit(100000)).alias("start_ms"), F.least("end_ms", F.lit(2000000)).alias("end_ms")).where("start_ms < end_ms")
    return I.merge_intervals(clipped, ("session_id", "cluster"))


@query("interval_difference", T.sql(S, T.KEPT_SQL, body="""
, cut AS (SELECT session_id, source, min(start_ms) AS c0, max(end_ms) AS c1 FROM kept GROUP BY ALL),
m AS (SELECT s.*, c0, c1 FROM segments s JOIN cut USING (session_id, source))
SELECT session_id, source, seg_id, cluster, start_ms, end_ms FROM m WHERE c1 < start_ms OR c0 > end_ms
UNION ALL SELECT session_id, source, seg_id, cluster, start_ms, c0 - 1 FROM m WHERE NOT (c1 < start_ms OR c0 > end_ms) AND start_ms <= c0 - 1
UNION ALL SELECT session_id, source, seg_id, cluster, c1 + 1, end_ms FROM m WHERE NOT (c1 < start_ms OR c0 > end_ms) AND c1 + 1 <= end_ms"""))
def interval_difference(spark, sf_dir):
    cut = T.kept_ranges(spark, sf_dir).groupBy("session_id", "source").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return I.subtract(T.segments(spark, sf_dir), cut).select("session_id", "source", "seg_id", "cluster", "start_ms", "end_ms")


@query("overlap_sweep", T.sql(S, body="""
, bars AS (SELECT DISTINCT session_id, cluster AS lane, start_ms, end_ms FROM segments),
edges AS (SELECT session_id, start_ms AS t FROM bars UNION SELECT session_id, end_ms FROM bars),
cells AS (SELECT session_id, t AS a, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS b FROM edges),
on_air AS (SELECT c.session_id, a, b, list_sort(list(DISTINCT lane)) AS l FROM cells c JOIN bars ON bars.session_id = c.session_id AND start_ms <= a AND end_ms >= b WHERE b IS NOT NULL GROUP BY ALL),
two AS (SELECT session_id, a, b, l[1] AS x, l[2] AS y FROM on_air WHERE len(l) >= 2),
marked AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(x) OVER w = x AND lag(y) OVER w = y THEN 0 ELSE 1 END AS fresh FROM two WINDOW w AS (PARTITION BY session_id ORDER BY a))
SELECT session_id, min(a) AS start_ms, max(b) AS end_ms, min(x) AS lane_a, min(y) AS lane_b FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY session_id, run"""))
def overlap_sweep(spark, sf_dir):
    return I.overlap_sweep(T.segments(spark, sf_dir).withColumnRenamed("cluster", "lane"))


@query("name_by_overlap", T.sql(S, body="""
, lines AS (SELECT session_id, source, event_id AS ordinal, p AS start_ms, p + 3000 AS end_ms, event_type AS speaker FROM ev WHERE event_id % 10 = 0)
SELECT s.session_id, s.source, s.seg_id, s.start_ms, s.end_ms, coalesce(n.speaker, CASE WHEN s.source = 'mic' THEN 'mic_' ELSE 'spk_' END || s.cluster) AS label FROM segments s LEFT JOIN (
  SELECT s.seg_id, l.speaker FROM segments s JOIN lines l USING (session_id, source) WHERE least(s.end_ms, l.end_ms) > greatest(s.start_ms, l.start_ms)
  QUALIFY row_number() OVER (PARTITION BY s.seg_id ORDER BY least(s.end_ms, l.end_ms) - greatest(s.start_ms, l.start_ms) DESC, l.ordinal DESC) = 1) n USING (seg_id)"""))
def name_by_overlap(spark, sf_dir):
    lines = T.events(spark, sf_dir).where("event_id % 10 = 0").select("session_id", "source", F.col("event_id").alias("ordinal"), F.col("p").alias("start_ms"), (F.col("p") + 3000).alias("end_ms"), F.col("event_type").alias("speaker"))
    return I.name_by_overlap(T.segments(spark, sf_dir), lines).select("session_id", "source", "seg_id", "start_ms", "end_ms", "label")


@query("clip_words", T.sql(W, body=f"""
SELECT session_id, source, word_id, (greatest(start_ms - 500000, 0) + 5) // 10 * 10 AS clip_start,
  greatest((least(greatest(end_ms - 500000, 0), 1000000) + 5) // 10 * 10, (greatest(start_ms - 500000, 0) + 5) // 10 * 10 + 10) AS clip_end
FROM words w WHERE {_mid()} >= 500000 AND {_mid()} < 1500000"""))
def clip_words(spark, sf_dir):
    return I.clip_words(T.words(spark, sf_dir), 500000, 1500000).select("session_id", "source", "word_id", "clip_start", "clip_end")


@query("line_words", T.sql(W, body=f"SELECT w.* FROM words w WHERE source = 'mic' AND {_mid()} BETWEEN 250000 AND 750000"))
def line_words(spark, sf_dir):
    return T.words(spark, sf_dir).where((F.col("source") == "mic") & I.midpoint().between(250000, 750000))


@query("recording_overlaps", T.sql(body="""
, r AS (SELECT session_id, event_id AS rec_id, p AS start_ms, p + 2000 AS end_ms FROM ev)
SELECT a.session_id, a.rec_id AS a, b.rec_id AS b FROM r a JOIN r b ON a.session_id = b.session_id AND a.rec_id < b.rec_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms"""))
def recording_overlaps(spark, sf_dir):
    rows = T.events(spark, sf_dir).select("session_id", F.col("event_id").alias("rec_id"), F.col("p").alias("start_ms"), (F.col("p") + 2000).alias("end_ms"))
    return I.recording_overlaps(rows, ("session_id",))


@query("other_voice_chunks", T.sql(S, body="""
, o AS (SELECT a.seg_id, sum(greatest(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms), 0)) AS other_ms FROM segments a JOIN segments b ON a.session_id = b.session_id AND a.source = b.source AND a.cluster <> b.cluster GROUP BY ALL),
r AS (SELECT s.*, CAST(coalesce(other_ms, 0) AS BIGINT) AS other_ms, coalesce(other_ms, 0) >= 200 AS crowded FROM segments s LEFT JOIN o USING (seg_id))
SELECT *, NOT crowded OR bool_and(crowded) OVER (PARTITION BY session_id, source, cluster) AS used FROM r"""))
def other_voice_chunks(spark, sf_dir):
    return I.other_voice_chunks(T.segments(spark, sf_dir))


@query("learnable_chunks", T.sql(S, T.KEPT_SQL, body="""
, lines AS (SELECT session_id, source, event_id AS line_id, p AS start_ms, p + 6000 AS end_ms FROM ev WHERE event_id % 11 = 0)
SELECT s.session_id, s.source, s.seg_id, l.line_id, s.start_ms, s.end_ms FROM segments s JOIN lines l USING (session_id, source)
WHERE s.end_ms - s.start_ms >= 1500 AND 2 * greatest(least(s.end_ms, l.end_ms) - greatest(s.start_ms, l.start_ms), 0) >= s.end_ms - s.start_ms
  AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.session_id = s.session_id AND k.source = s.source AND s.start_ms < k.end_ms AND k.start_ms < s.end_ms)"""))
def learnable_chunks(spark, sf_dir):
    p = F.col("p")
    lines = T.events(spark, sf_dir).where("event_id % 11 = 0").select("session_id", "source", F.col("event_id").alias("line_id"), p.alias("start_ms"), (p + 6000).alias("end_ms"))
    return I.learnable(T.segments(spark, sf_dir), lines, T.kept_ranges(spark, sf_dir)).select("session_id", "source", "seg_id", "line_id", "start_ms", "end_ms")


@query("line_routing", T.sql(W, T.KEPT_SQL, body=f"""
SELECT w.*, CASE WHEN w.source = 'system' AND w.text IN ('click', 'view') AND k.word_id IS NULL THEN 'hidden' WHEN w.start_ms >= 300000 AND w.start_ms < 2000000 THEN 'shown' ELSE 'outside' END AS route
FROM words w LEFT JOIN (SELECT DISTINCT w.word_id FROM words w JOIN kept k USING (session_id, source) WHERE {_mid()} BETWEEN k.start_ms AND k.end_ms) k USING (word_id)"""))
def line_routing(spark, sf_dir):
    """Hidden before outside; the span is half-open, a kept range shows what would be hidden."""
    words = T.words(spark, sf_dir)
    kept = I.in_any_range(words, T.kept_ranges(spark, sf_dir)).select("word_id", F.lit(True).alias("kept"))
    hidden = (F.col("source") == "system") & F.col("text").isin("click", "view") & F.col("kept").isNull()
    shown = (F.col("start_ms") >= 300000) & (F.col("start_ms") < 2000000)
    return words.join(kept, "word_id", "left").withColumn("route", F.when(hidden, "hidden").when(shown, "shown").otherwise("outside")).drop("kept")


@query("correction_upsert", T.sql(T.CORRECTIONS_SQL, body="""
, new AS (SELECT * FROM corrections WHERE ordinal % 2 = 0 AND ordinal % 3 = 0), old AS (SELECT * FROM corrections WHERE ordinal % 3 <> 0)
SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.session_id = o.session_id AND n.source = o.source AND ((o.start_ms < n.end_ms AND n.start_ms < o.end_ms) OR (o.start_ms = n.start_ms AND o.end_ms = n.end_ms)) AND (NOT n.inferred OR o.inferred))
UNION ALL SELECT * FROM new"""))
def correction_upsert(spark, sf_dir):
    """New locks replace what they strictly overlap or equal; an inferred one never replaces a lock."""
    rows = T.corrections(spark, sf_dir)
    new, old = rows.where("ordinal % 2 = 0 AND ordinal % 3 = 0"), rows.where("ordinal % 3 <> 0")
    collide = "((start_ms < r_end_ms AND r_start_ms < end_ms) OR (start_ms = r_start_ms AND end_ms = r_end_ms)) AND (NOT r_inferred OR inferred)"
    gone = I.range_join(old, new, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), F.col("end_ms"))).where(collide).select("ordinal").distinct()
    return old.join(gone, "ordinal", "left_anti").unionByName(new)
