"""Queries of the sequence operators, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import intervals as I
from timeweave.operators import sequences as Q
from timeweave.plans.catalogue import query
from timeweave.sources import tables as T

W, S, FR = T.WORDS_SQL, T.SEGMENTS_SQL, T.FRAMES_SQL
SESSION = ("session_id",)


@query("utterances_by_gap", T.sql(W, body="""
, m AS (SELECT *, CASE WHEN lag(grp) OVER w IS DISTINCT FROM grp OR lag(start_ms) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM (SELECT *, text IN ('click', 'view') AS grp FROM words) WINDOW w AS (PARTITION BY session_id, source ORDER BY start_ms, end_ms, word_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms, word_id) AS block FROM m),
r AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY session_id, source, block ORDER BY start_ms, end_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1000 THEN 0 ELSE 1 END AS n FROM b),
u AS (SELECT *, sum(n) OVER (PARTITION BY session_id, source, block ORDER BY start_ms, end_ms, word_id) AS run FROM r)
SELECT session_id, source, grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(text, ' ' ORDER BY start_ms, end_ms, word_id) AS text FROM u GROUP BY session_id, source, grp, block, run"""))
def utterances_by_gap(spark, sf_dir):
    return Q.utterances_by_gap(T.words(spark, sf_dir).withColumn("grp", F.col("text").isin("click", "view")), ("grp",))


@query("utterances_full")
def utterances_full(spark, sf_dir):
    """Words to lines with names, corrections, kept ranges and turns."""
    words, segments = T.words(spark, sf_dir), T.segments(spark, sf_dir)
    named = I.name_words(I.assign_cluster(words, segments), I.anonymous_names(segments))
    locked = I.overlay_corrections(words, T.corrections(spark, sf_dir)).select("word_id", F.col("speaker").alias("_c"), "locked")
    turns = I.overlay_turns(words, T.turns(spark, sf_dir)).select("word_id", F.concat_ws(":", "group_id", "turn").alias("turn"), F.col("speaker").alias("_t"))
    kept = I.in_any_range(words, T.kept_ranges(spark, sf_dir)).select("word_id", F.lit(True).alias("_k"))
    full = named.join(locked, "word_id").join(turns, "word_id", "left").join(kept, "word_id", "left")
    full = full.select(
        "session_id", "source", "word_id", "start_ms", "end_ms", F.concat("text", F.when(F.col("word_id") % 5 == 0, ".").otherwise("")).alias("text"),
        F.col("name").alias("speaker_id"), F.coalesce("_t", "_c", "name").alias("speaker"), (F.col("locked") | F.col("_t").isNotNull()).alias("locked"),
        F.coalesce("_k", F.lit(False)).alias("kept"), ((F.col("source") == "mic") & (F.col("word_id") % 17 == 0)).alias("echo"), "turn",
    )
    return Q.utterances(full)


@query("mic_phrases", T.sql(W, body="""
, RECURSIVE_NOTE AS (SELECT 1),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms, word_id) AS i, lag(end_ms) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms, word_id) AS pe FROM words WHERE source = 'mic'),
f AS (SELECT session_id, source, i, start_ms AS ps, end_ms AS mx, 1 AS phrase FROM o WHERE i = 1
  UNION ALL SELECT o.session_id, o.source, o.i,
    CASE WHEN o.start_ms - o.pe > 900 OR o.end_ms - f.ps > 12000 THEN o.start_ms ELSE f.ps END,
    o.end_ms, CASE WHEN o.start_ms - o.pe > 900 OR o.end_ms - f.ps > 12000 THEN f.phrase + 1 ELSE f.phrase END
  FROM f JOIN o ON o.session_id = f.session_id AND o.source = f.source AND o.i = f.i + 1)
SELECT session_id, source, min(ps) AS start_ms, max(mx) AS end_ms, count(*) AS n FROM f GROUP BY session_id, source, phrase""").replace("WITH ev", "WITH RECURSIVE ev").replace("RECURSIVE_NOTE AS (SELECT 1),\n", ""))
def mic_phrases(spark, sf_dir):
    return Q.phrases(T.words(spark, sf_dir).where("source = 'mic'"))


@query("vad_regions", T.sql(FR, body="""
, a AS (SELECT session_id, source, frame, lag(frame) OVER (PARTITION BY session_id, source ORDER BY frame) AS b FROM frames WHERE rms > 0.01),
r AS (SELECT *, sum(CASE WHEN frame - b <= 41 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, source ORDER BY frame) AS run FROM a),
raw AS (SELECT session_id, source, min(frame) AS a, max(frame) + 1 AS b FROM r GROUP BY session_id, source, run HAVING max(frame) + 1 - min(frame) >= 13),
m AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY session_id, source ORDER BY a) <= 60 THEN 0 ELSE 1 END AS n FROM raw),
j AS (SELECT session_id, source, greatest(min(a) - 15, 0) AS a, max(b) + 15 AS b FROM (SELECT *, sum(n) OVER (PARTITION BY session_id, source ORDER BY a) AS k FROM m) GROUP BY session_id, source, k),
l AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY session_id, source ORDER BY a) THEN 0 ELSE 1 END AS n FROM j)
SELECT session_id, source, min(a) AS start_frame, max(b) AS end_frame FROM (SELECT *, sum(n) OVER (PARTITION BY session_id, source ORDER BY a) AS k FROM l) GROUP BY session_id, source, k"""))
def vad_regions(spark, sf_dir):
    return Q.speech_regions(T.frames(spark, sf_dir), F.col("rms") > 0.01, hangover=40, merge=60)


@query("echo_smoothing", T.sql(W, body="""
, m AS (SELECT *, text IN ('click', 'purchase') AS mark, text <> 'error' AS ok FROM words)
SELECT session_id, source, word_id, mark OR (coalesce(lag(mark) OVER w, false) AND coalesce(lead(mark) OVER w, false) AND ok) AS smoothed FROM m WINDOW w AS (PARTITION BY session_id, source ORDER BY start_ms, word_id)"""))
def echo_smoothing(spark, sf_dir):
    marked = T.words(spark, sf_dir).withColumn("mark", F.col("text").isin("click", "purchase")).withColumn("ok", F.col("text") != "error")
    return Q.smooth_marks(marked, Q.KEYS, ("start_ms", "word_id"), "mark", "ok").select("session_id", "source", "word_id", "smoothed")


@query("echo_runs", T.sql(W, body="""
, m AS (SELECT *, text IN ('click', 'view', 'purchase') AS mark FROM words),
c AS (SELECT *, CASE WHEN lag(mark) OVER w IS DISTINCT FROM mark THEN 1 ELSE 0 END AS n FROM m WINDOW w AS (PARTITION BY session_id, source ORDER BY start_ms, word_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY session_id, source ORDER BY start_ms, word_id) AS run FROM c)
SELECT session_id, source, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM r WHERE mark GROUP BY session_id, source, run"""))
def echo_runs(spark, sf_dir):
    return Q.mark_runs(T.words(spark, sf_dir).withColumn("mark", F.col("text").isin("click", "view", "purchase")), Q.KEYS, ["start_ms", "word_id"], "mark")


@query("room_stretches", T.sql(FR, body="""
, a AS (SELECT session_id, frame, frame - lag(frame) OVER (PARTITION BY session_id ORDER BY frame) AS d FROM frames WHERE source = 'mic' AND rms >= 0.02),
r AS (SELECT *, sum(CASE WHEN d <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY frame) AS run FROM a)
SELECT session_id, greatest(min(frame) * 10 - 250, 0) AS start_ms, (max(frame) + 1) * 10 + 250 AS end_ms, count(*) AS n FROM r GROUP BY session_id, run HAVING count(*) >= 4"""))
def room_stretches(spark, sf_dir):
    return Q.frame_runs(T.frames(spark, sf_dir).where("source = 'mic'"), F.col("rms") >= 0.02, SESSION, gap=300, least=4)


@query("sub_windows", T.sql(S, body="""
, n AS (SELECT *, (end_ms - start_ms + 699) // 700 AS k FROM segments WHERE end_ms > start_ms)
SELECT session_id, source, seg_id, cluster, start_ms, end_ms, part, start_ms + (end_ms - start_ms) * part // k AS win_start, start_ms + (end_ms - start_ms) * (part + 1) // k AS win_end FROM n, LATERAL (SELECT unnest(range(k)) AS part)"""))
def sub_windows(spark, sf_dir):
    return Q.sub_windows(T.segments(spark, sf_dir), 700)


@query("sliding_windows", T.sql(W, body="""
, g AS (SELECT session_id, source, start_ms, unnest(range(start_ms // 1000 + 1)) AS k FROM words)
SELECT session_id, source, k * 1000 AS win_start, count(*) AS n FROM g WHERE k * 1000 <= start_ms AND start_ms < k * 1000 + 10000 GROUP BY ALL"""))
def sliding_windows(spark, sf_dir):
    return Q.sliding_counts(T.words(spark, sf_dir), "start_ms", 10_000, 1000)


@query("frame_vote_topk", T.sql(S, body="""
, v AS (SELECT session_id, start_ms // 5000 AS frame, cluster, count(*) AS votes FROM segments GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, frame ORDER BY votes DESC, cluster) AS INTEGER) AS rank FROM v) WHERE rank <= 2"""))
def frame_vote_topk(spark, sf_dir):
    return Q.frame_votes(T.segments(spark, sf_dir).select("session_id", F.expr("start_ms DIV 5000").alias("frame"), "cluster"), 2)


@query("monotone_words", T.sql(W, body="""
, r AS (SELECT session_id, source, word_id, end_ms, greatest(start_ms, coalesce(max(end_ms) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS new_start FROM words)
SELECT session_id, source, word_id, new_start, greatest(end_ms, new_start) AS new_end FROM r"""))
def monotone_words(spark, sf_dir):
    return Q.monotone(T.words(spark, sf_dir)).select("session_id", "source", "word_id", "new_start", "new_end")


@query("renumber_labels", T.sql(W, body="""
, f AS (SELECT session_id, text, min(start_ms) AS first_at FROM words GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY first_at, text) - 1 AS INTEGER) AS number FROM f"""))
def renumber_labels(spark, sf_dir):
    return Q.renumber(T.words(spark, sf_dir), SESSION, "text", "start_ms")


@query("evenly_spaced", T.sql(W, body="""
, r AS (SELECT session_id, word_id, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, word_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM words)
SELECT session_id, word_id FROM r WHERE n <= 40 OR i IN (SELECT k * n // 40 FROM range(40) t(k))"""))
def evenly_spaced(spark, sf_dir):
    return Q.evenly_spaced(T.words(spark, sf_dir), SESSION, ("start_ms", "word_id"), 40).select("session_id", "word_id")


PIECES_SQL = """pieces AS (SELECT o_custkey, o_orderkey, length_ms, CAST(coalesce(sum(length_ms + 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) % 90000 + 1000 AS length_ms FROM orders))"""


def _pieces(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").withColumn("length_ms", F.floor("o_totalprice") % 90000 + 1000)
    return Q.cumulative_offsets(rows, ("o_custkey",), ("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "length_ms", "offset_ms")


@query("cumulative_offsets", f"WITH {PIECES_SQL} SELECT * FROM pieces")
def cumulative_offsets(spark, sf_dir):
    return _pieces(spark, sf_dir)


@query("seams", f"WITH {PIECES_SQL} SELECT o_custkey, offset_ms + length_ms AS start_ms, nxt AS end_ms FROM (SELECT *, lead(offset_ms) OVER (PARTITION BY o_custkey ORDER BY offset_ms) AS nxt FROM pieces) WHERE nxt IS NOT NULL")
def seams(spark, sf_dir):
    return Q.seams(_pieces(spark, sf_dir), ("o_custkey",))


@query("clock_map", f"""WITH {PIECES_SQL}, pts AS (SELECT o_custkey, o_orderkey AS point_id, o_orderkey * 7919 % 400000 AS at_ms FROM orders)
SELECT p.o_custkey, point_id, at_ms, offset_ms AS piece_ms, least(at_ms - offset_ms, length_ms) AS elapsed_ms FROM pts p JOIN pieces c ON c.o_custkey = p.o_custkey AND offset_ms <= at_ms
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY offset_ms DESC) = 1""")
def clock_map(spark, sf_dir):
    points = T.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") * 7919 % 400000).alias("at_ms"))
    return Q.wallclock_at(points, _pieces(spark, sf_dir), ("o_custkey",))


LEVELS_SQL = "levels AS (SELECT session_id, source, p // 50 AS bucket, max(value) / 1000 AS rms FROM ev GROUP BY ALL)"
QUIET_SQL = """limits AS (SELECT session_id, source, least(greatest(4 * list_sort(list(rms))[CAST(count(*) // 10 + 1 AS INTEGER)], 0.003), 0.03) AS lim FROM levels GROUP BY ALL),
loud AS (SELECT DISTINCT session_id, bucket FROM levels JOIN limits USING (session_id, source) WHERE rms > lim),
edges AS (SELECT * FROM loud UNION ALL SELECT session_id, max(bucket) + 1 FROM levels GROUP BY 1 UNION ALL SELECT DISTINCT session_id, -1 FROM levels),
quiet AS (SELECT session_id, (b + 1) * 50 AS start_ms, bucket * 50 AS end_ms FROM (SELECT *, lag(bucket) OVER (PARTITION BY session_id ORDER BY bucket) AS b FROM edges) WHERE bucket - b > 1 AND (bucket - b - 1) * 50 >= 600)"""


def _levels(spark, sf_dir):
    return T.events(spark, sf_dir).groupBy("session_id", "source", F.expr("p DIV 50").alias("bucket")).agg((F.max("value") / 1000).alias("rms"))


@query("quiet_stretches", T.sql(LEVELS_SQL, QUIET_SQL, body="SELECT * FROM quiet"))
def quiet_stretches(spark, sf_dir):
    return Q.quiet_stretches(_levels(spark, sf_dir))


@query("snap_to_quiet", T.sql(LEVELS_SQL, QUIET_SQL, body="""
, pts AS (SELECT session_id, event_id AS point_id, p AS at_ms FROM ev),
c AS (SELECT q.session_id, point_id, at_ms, least(greatest(at_ms, q.start_ms + least((q.end_ms - q.start_ms) // 2, 1000)), q.end_ms - least((q.end_ms - q.start_ms) // 2, 1000)) AS s, q.start_ms FROM pts JOIN quiet q USING (session_id))
SELECT session_id, point_id, at_ms, s AS snapped_ms FROM c QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY abs(s - at_ms), start_ms) = 1"""))
def snap_to_quiet(spark, sf_dir):
    points = T.events(spark, sf_dir).select("session_id", F.col("event_id").alias("point_id"), F.col("p").alias("at_ms"))
    return Q.snap_to_quiet(points, Q.quiet_stretches(_levels(spark, sf_dir))).where("snapped_ms IS NOT NULL")


@query("row_ends", T.sql(W, body="SELECT session_id, word_id AS row_id, greatest(least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY session_id ORDER BY start_ms, word_id), end_ms)), start_ms + 1) AS row_end FROM words"))
def row_ends(spark, sf_dir):
    return Q.row_ends(T.words(spark, sf_dir).withColumnRenamed("word_id", "row_id"), SESSION).select("session_id", "row_id", "row_end")


@query("fold_bounds", T.sql(W, body="SELECT session_id, count_if(start_ms < 300000) AS leading, count_if(start_ms >= 2000000) AS trailing, count(*) AS n FROM words GROUP BY ALL"))
def fold_bounds(spark, sf_dir):
    return Q.fold_bounds(T.words(spark, sf_dir).withColumnRenamed("word_id", "row_id"), SESSION, 300000, 2000000)


@query("timeline_rows", T.sql(W, body="""
, o AS (SELECT session_id, word_id AS line_id, source, start_ms, end_ms, greatest(end_ms, start_ms + 1) AS last, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, word_id) AS k FROM words),
f AS (SELECT session_id, k, 0 AS row, line_id, source, start_ms, end_ms, [{'s': source, 'a': start_ms, 'b': last}] AS members FROM o WHERE k = 1
  UNION ALL
  SELECT session_id, k, CASE WHEN joins THEN row ELSE row + 1 END, line_id, source, start_ms, end_ms, CASE WHEN joins THEN list_append(members, own) ELSE [own] END
  FROM (SELECT o.session_id, o.k, f.row, o.line_id, o.source, o.start_ms, o.end_ms, f.members, {'s': o.source, 'a': o.start_ms, 'b': o.last} AS own,
          len(list_filter(f.members, lambda m: m.s <> o.source AND least(m.b, o.last) > greatest(m.a, o.start_ms) AND 2 * (least(m.b, o.last) - greatest(m.a, o.start_ms)) >= least(m.b - m.a, o.last - o.start_ms))) > 0 AS joins
        FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1))
SELECT session_id, row, line_id, source, start_ms, end_ms FROM f""").replace("WITH ", "WITH RECURSIVE ", 1))
def timeline_rows(spark, sf_dir):
    return Q.timeline_rows(T.words(spark, sf_dir).withColumnRenamed("word_id", "line_id").select("session_id", "line_id", "source", "start_ms", "end_ms"))


@query("token_groups", T.sql(W, body="""
, t AS (SELECT session_id, source, word_id, start_ms, end_ms, CASE WHEN word_id % 6 = 0 THEN '.' ELSE text END AS text FROM words),
m AS (SELECT *, CASE WHEN lag(start_ms) OVER w IS NOT NULL AND (text = '.' OR lag(start_ms) OVER w = start_ms) THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY session_id, source ORDER BY start_ms, end_ms, word_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms, word_id) AS token FROM m)
SELECT session_id, source, token, min(start_ms) AS start_ms, max(end_ms) AS end_ms, replace(string_agg(text, ' ' ORDER BY start_ms, end_ms, word_id), ' .', '.') AS text FROM g GROUP BY ALL"""))
def token_groups(spark, sf_dir):
    return Q.token_groups(T.words(spark, sf_dir).withColumn("text", F.when(F.col("word_id") % 6 == 0, ".").otherwise(F.col("text"))))
