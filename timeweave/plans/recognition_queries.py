"""Queries of speakers, learned voices and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import recognition as N
from timeweave.operators import rules as R
from timeweave.operators import sequences as Q
from timeweave.plans.catalogue import query
from timeweave.plans.vector_queries import CENTROIDS_SQL
from timeweave.sources import tables as T

#: Segments with the voice of a sample each.
CHUNKS_SQL = "chunks AS (SELECT session_id, source, seg_id, start_ms, end_ms, cluster, v, name, sample_no FROM segments JOIN samples ON sample_no = seg_id // 4 % 500)"


def _chunks(spark, sf_dir):
    voices = T.samples(spark, sf_dir).where("sample_no < 500").select(F.col("sample_no").alias("_k"), "v", "name", "sample_no")
    return T.segments(spark, sf_dir).withColumn("_k", F.expr("seg_id DIV 4 % 500")).join(voices, "_k").drop("_k")


_RECOGNIZED = """
, oth AS (SELECT a.seg_id, sum(greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))) AS o FROM chunks a JOIN chunks b USING (session_id, source) WHERE a.cluster <> b.cluster AND a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms GROUP BY ALL),
lng AS (SELECT c.*, coalesce(o, 0) >= 200 AS crowded FROM chunks c LEFT JOIN oth USING (seg_id) WHERE c.end_ms - c.start_ms >= 1500),
used AS (SELECT * FROM lng QUALIFY NOT crowded OR min(crowded::INT) OVER (PARTITION BY session_id, source, cluster) = 1),
cp AS (SELECT session_id, source, cluster, i, sum(x / n) AS s FROM (SELECT session_id, source, cluster, unnest(v) AS x, unnest(range(len(v))) AS i, sqrt(list_inner_product(v, v)) AS n FROM used) GROUP BY ALL),
cc AS (SELECT session_id, source, cluster, list(s ORDER BY i) AS s FROM cp GROUP BY ALL),
pre AS (SELECT session_id, source, cluster, name FROM (SELECT cc.*, name, list_inner_product(s, centroid) / sqrt(list_inner_product(s, s)) AS score FROM cc, centroids {allowed}) QUALIFY row_number() OVER (PARTITION BY session_id, source, cluster ORDER BY score DESC, name) <= 5),
d AS (SELECT u.session_id, u.source, u.cluster, u.seg_id, pre.name, list_inner_product(u.v, s.v) AS d, s.sample_no FROM used u JOIN pre USING (session_id, source, cluster) JOIN samples s ON s.name = pre.name),
t AS (SELECT session_id, source, cluster, seg_id, name, avg(d) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source, seg_id, name ORDER BY d DESC, sample_no) AS r FROM d) WHERE r <= 3 GROUP BY ALL),
m AS (SELECT session_id, source, cluster, name, median(score) AS score FROM t GROUP BY ALL),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id, source, cluster ORDER BY score DESC, name) = 1)
SELECT session_id, source, cluster, name AS best_candidate, round(score, 6) AS score, CASE WHEN score >= 0.45 THEN name END AS speaker FROM (SELECT DISTINCT session_id, source, cluster FROM chunks) LEFT JOIN b USING (session_id, source, cluster)"""
_R = T.sql(T.SEGMENTS_SQL, T.SAMPLES_SQL, CHUNKS_SQL, CENTROIDS_SQL, body=_RECOGNIZED)


@query("recognized_speakers", _R.format(allowed=""))
def recognized_speakers(spark, sf_dir):
    """M10 over all people."""
    return N.recognized(_chunks(spark, sf_dir), T.samples(spark, sf_dir), 0.45).withColumn("score", F.round("score", 6))


@query("recognized_attendees", _R.format(allowed="WHERE (cc.session_id + ascii(right(name, 1))) % 3 <> 0"))
def recognized_attendees(spark, sf_dir):
    """M10 over the people that each meeting allows."""
    chunks, samples = _chunks(spark, sf_dir), T.samples(spark, sf_dir)
    allowed = chunks.select("session_id", "source").distinct().withColumn("name", F.explode(F.array(*[F.lit(f"person{k}") for k in range(10)]))).where("(session_id + ascii(right(name, 1))) % 3 <> 0")
    return N.recognized(chunks, samples, 0.45, allowed).withColumn("score", F.round("score", 6))


def _items(spark, sf_dir):
    """Three local voices a window, of twenty tracks."""
    rows = T.samples(spark, sf_dir)
    k = F.col("sample_no")
    return rows.select((k % 10).alias("session_id"), F.when(k % 20 < 10, "mic").otherwise("system").alias("source"), F.expr("sample_no DIV 60").alias("chunk"), F.expr("CAST(sample_no DIV 20 % 3 AS INT)").alias("local"), (k % 5).cast("double").alias("clean_s"), (k % 7 / 5).alias("active_s"), F.when(k % 23 != 22, F.col("v")).alias("v"))


@query("local_speakers")
def local_speakers(spark, sf_dir):
    """Clusters of all tracks' local voices."""
    return N.local_speakers(_items(spark, sf_dir), 0.7)


@query("voice_turns", T.sql(body="""
, a AS (SELECT session_id, source, event_id % 2 AS chunk, CAST(user_id % 3 AS INTEGER) AS local, p // 100 AS frame FROM ev),
f AS (SELECT session_id, source, frame, count(*) AS speakers, 2 AS windows FROM a GROUP BY ALL),
v AS (SELECT session_id, source, frame, CAST((local + chunk) % 3 AS INTEGER) AS cluster, count(*) AS votes FROM a GROUP BY ALL),
k AS (SELECT v.* FROM v JOIN f USING (session_id, source, frame) QUALIFY row_number() OVER (PARTITION BY session_id, source, frame ORDER BY votes DESC, cluster) <= floor(speakers / windows + 0.5)),
n AS (SELECT *, CASE WHEN frame - lag(frame) OVER w - 1 < 30 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY session_id, source, cluster ORDER BY frame)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id, source, cluster ORDER BY frame) AS run FROM n)
SELECT session_id, source, cluster, least(min(frame) * 17, 400000) AS start_ms, least((max(frame) + 1) * 17, 400000) AS end_ms FROM r GROUP BY session_id, source, cluster, run HAVING least((max(frame) + 1) * 17, 400000) > least(min(frame) * 17, 400000)"""))
def voice_turns(spark, sf_dir):
    """M9's reconstruction: votes of two windows to turns."""
    activity = T.events(spark, sf_dir).select("session_id", "source", (F.col("event_id") % 2).alias("chunk"), (F.col("user_id") % 3).cast("int").alias("local"), F.expr("p DIV 100").alias("frame"))
    frames = activity.groupBy("session_id", "source", "frame").agg(F.count(F.lit(1)).alias("speakers"), F.lit(2).alias("windows"))
    speakers = activity.select("session_id", "source", "chunk", "local").distinct().withColumn("cluster", ((F.col("local") + F.col("chunk")) % 3).cast("int"))
    return N.voice_turns(activity, speakers, frames, end_ms=400_000)


_LINES = "lines AS (SELECT session_id, source, seg_id AS line_id, start_ms, end_ms, seg_id % 3 <> 0 AS locked, CASE WHEN seg_id % 5 = 0 THEN seg_id % 10 END AS group_id, name AS speaker FROM chunks)"


def _lines(spark, sf_dir):
    s = F.col("seg_id")
    return _chunks(spark, sf_dir).select("session_id", "source", s.alias("line_id"), "start_ms", "end_ms", (s % 3 != 0).alias("locked"), F.when(s % 5 == 0, s % 10).alias("group_id"), F.col("name").alias("speaker"))


@query("learned_lines", T.sql(T.SEGMENTS_SQL, T.SAMPLES_SQL, CHUNKS_SQL, _LINES, T.KEPT_SQL, body="""
, st AS (SELECT name, v FROM samples WHERE sample_no % 4 <> 1),
c AS (SELECT * FROM chunks WHERE end_ms - start_ms >= 1500 AND NOT EXISTS (SELECT 1 FROM kept g WHERE g.session_id = chunks.session_id AND g.source = chunks.source AND chunks.start_ms < g.end_ms AND g.start_ms < chunks.end_ms))
SELECT DISTINCT l.session_id, l.source, l.line_id FROM lines l JOIN c ON c.session_id = l.session_id AND c.source = l.source AND 2 * (least(c.end_ms, l.end_ms) - greatest(c.start_ms, l.start_ms)) >= c.end_ms - c.start_ms
WHERE l.locked AND l.group_id IS NULL AND EXISTS (SELECT 1 FROM st WHERE st.name = l.speaker AND list_inner_product(st.v, c.v) >= 0.999)"""))
def learned_lines(spark, sf_dir):
    """J16; three of four samples are stored, and kept ranges stand for cut groups."""
    return N.learned_lines(_lines(spark, sf_dir), _chunks(spark, sf_dir), T.kept_ranges(spark, sf_dir), T.samples(spark, sf_dir).where("sample_no % 4 <> 1"))


@query("placed_lines", T.sql(T.SEGMENTS_SQL, T.SAMPLES_SQL, CHUNKS_SQL, _LINES, body="""
, g AS (SELECT session_id, group_id, min(start_ms) AS s FROM lines WHERE group_id IS NOT NULL GROUP BY ALL)
SELECT session_id, line_id, coalesce(s, start_ms) AS line_start FROM lines LEFT JOIN g USING (session_id, group_id)"""))
def placed_lines(spark, sf_dir):
    """J33."""
    lines = _lines(spark, sf_dir)
    return N.placed_lines(lines, lines.where("group_id IS NOT NULL").select("session_id", "group_id", "start_ms")).select("session_id", "line_id", "line_start")


@query("forgotten_samples", T.sql(T.SEGMENTS_SQL, T.SAMPLES_SQL, CHUNKS_SQL, T.KEPT_SQL, body="""
, st AS (SELECT DISTINCT name, sample_no, session_id AS session, source, v FROM chunks),
x AS (SELECT DISTINCT c.session_id, c.source, c.v FROM chunks c JOIN kept k ON c.session_id = k.session_id AND c.source = k.source AND c.start_ms < k.end_ms AND k.start_ms < c.end_ms)
SELECT name, sample_no, session, source FROM st WHERE (name, sample_no) NOT IN (SELECT (st.name, st.sample_no) FROM st JOIN x ON x.session_id = st.session AND x.source = st.source AND list_inner_product(st.v, x.v) >= 0.999)"""))
def forgotten_samples(spark, sf_dir):
    """What is left after the lines at kept ranges were cut."""
    chunks = _chunks(spark, sf_dir)
    stored = chunks.select("name", "sample_no", F.col("session_id").alias("session"), "source", "v").distinct()
    return N.forgotten_samples(stored, chunks, T.kept_ranges(spark, sf_dir)).select("name", "sample_no", "session", "source")


@query("token_turns", T.sql(T.WORDS_SQL, body="""
, c AS (SELECT DISTINCT session_id, source, start_ms AS cut_ms FROM words WHERE word_id % 7 = 0)
SELECT session_id, source, word_id AS token, start_ms, (SELECT max(cut_ms) FROM c WHERE c.session_id = w.session_id AND c.source = w.source AND c.cut_ms <= w.start_ms) AS cut_ms FROM words w"""))
def token_turns(spark, sf_dir):
    """Cuts at every seventh word."""
    words = T.words(spark, sf_dir)
    cuts = words.where("word_id % 7 = 0").select("session_id", "source", F.col("start_ms").alias("cut_ms")).distinct()
    return Q.token_turns(words.withColumnRenamed("word_id", "token"), cuts, ["session_id", "source"])


_CHUNK_ORDER = "row_number() OVER (PARTITION BY session_id ORDER BY start_ms, CASE source WHEN 'mic' THEN 0 ELSE 1 END, cluster, end_ms, seg_id)"


@query("chunk_order", T.sql(T.SEGMENTS_SQL, body=f"SELECT session_id, seg_id, CAST({_CHUNK_ORDER} AS INTEGER) AS place FROM segments"))
def chunk_order(spark, sf_dir):
    """K2."""
    return R.in_order(T.segments(spark, sf_dir), ("session_id",), R.CHUNK_ORDER, "seg_id").select("session_id", "seg_id", "place")


@query("utterance_order", T.sql(T.UTTERANCES_SQL, body="SELECT session_id, turn, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn // 3, CASE source WHEN 'mic' THEN 0 ELSE 1 END, turn) AS INTEGER) AS place FROM utt WHERE turn % 4 <> 1 AND regexp_replace(text, '\\s', '', 'g') <> ''"))
def utterance_order(spark, sf_dir):
    """K3: empty lines are dropped, equal starts go by source and stay in their order."""
    rows = T.utterances(spark, sf_dir).withColumn("start_ms", F.expr("turn DIV 3")).withColumn("text", F.when(F.col("turn") % 4 == 1, "  ").otherwise(F.col("text")))
    return R.in_order(rows.where(R.has_text("text")), ("session_id",), R.UTTERANCE_ORDER, "turn").select("session_id", "turn", "place")


@query("piece_order", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderpriority, o_orderkey) AS INTEGER) AS place FROM orders")
def piece_order(spark, sf_dir):
    """K7: pieces by start, then name; those without a valid start last."""
    rows = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("start"), F.col("o_orderpriority").alias("name"))
    return R.in_order(rows, ("o_custkey",), R.PIECE_ORDER, "o_orderkey").select("o_orderkey", "place")


@query("nearest_in_time", T.sql(T.SEGMENTS_SQL, body="SELECT session_id, seg_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY abs(start_ms - 500000), start_ms, seg_id) AS INTEGER) AS place FROM segments"))
def nearest_in_time(spark, sf_dir):
    """K8: by distance from a time."""
    return R.nearest_first(T.segments(spark, sf_dir).withColumn("at_ms", F.lit(500_000)), ("session_id",), "seg_id").select("session_id", "seg_id", "place")


@query("mark_checks", T.sql(T.SEGMENTS_SQL, body="""
SELECT seg_id, start_ms < end_ms AND end_ms <= 2000000 AND start_ms < 2000000 AS may_mark,
  greatest(start_ms - greatest(3000 - (end_ms - start_ms), 0) // 2, 0) AS pad_start, end_ms + greatest(3000 - (end_ms - start_ms), 0) // 2 AS pad_end, greatest(start_ms - 250 * cluster, 0) AS shifted FROM segments"""))
def mark_checks(spark, sf_dir):
    """Spans that may be marked, widened to three seconds, and shifted by a delay."""
    rows = T.segments(spark, sf_dir)
    a, b = R.padded_interval(F.col("start_ms"), F.col("end_ms"), 3000)
    may = R.can_mark(F.lit(1000) * F.col("cluster"), F.lit(None).cast("long"), F.lit(2_000_000), F.col("start_ms"), F.col("end_ms"))
    return rows.select("seg_id", may.alias("may_mark"), a.alias("pad_start"), b.alias("pad_end"), R.shifted(F.col("start_ms"), F.col("cluster") * 250).alias("shifted"))


@query("fitting_bars", T.sql(T.SEGMENTS_SQL, body="""
, c AS (SELECT session_id, seg_id, cluster AS lane, greatest(start_ms, 100000) - 100000 AS a, least(end_ms, 900000) - 100000 AS b FROM segments WHERE cluster <= 2 OR seg_id % 8 = 0)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY a, b, seg_id) AS INTEGER) AS bar, seg_id, lane, a AS start_ms, b AS end_ms FROM c WHERE b - a >= 50"""))
def fitting_bars(spark, sf_dir):
    """Bars of lanes that are there, or unsure, cut to the clip; very short ones go; numbered from 1."""
    rows = T.segments(spark, sf_dir).select("session_id", "seg_id", F.col("cluster").alias("lane"), (F.col("seg_id") % 8 == 0).alias("unsure"), "start_ms", "end_ms")
    return R.fitting_bars(rows, 2, 100_000, 900_000).select("session_id", "bar", "seg_id", "lane", "start_ms", "end_ms")


@query("mic_diarization", T.sql(T.SEGMENTS_SQL, body="SELECT session_id, bool_or(source = 'mic') AND session_id % 2 = 0 AS effective FROM segments GROUP BY session_id"))
def mic_diarization(spark, sf_dir):
    """P25: asked for, and the microphone has segments."""
    return R.mic_diarization(T.segments(spark, sf_dir).withColumn("requested", F.col("session_id") % 2 == 0))


@query("local_offsets", "SELECT o_orderkey, CAST(date_diff('minute', o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE 'UTC', o_orderdate) AS INTEGER) AS utc, CAST(date_diff('minute', o_orderdate, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata') AS INTEGER) AS kolkata FROM orders")
def local_offsets(spark, sf_dir):
    """F16: minutes east of UTC that a zone's own table gives."""
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"))
    return rows.select("o_orderkey", R.local_offset(F.col("s"), "UTC").alias("utc"), R.local_offset(F.col("s"), "Asia/Kolkata").alias("kolkata"))
