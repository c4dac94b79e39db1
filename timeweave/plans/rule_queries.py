"""Queries of the row rules and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import rules as R
from timeweave.plans.catalogue import query
from timeweave.plans.sequence_queries import PIECES_SQL, _pieces
from timeweave.sources import tables as T

W, S = T.WORDS_SQL, T.SEGMENTS_SQL


@query("line_keep", T.sql(W, body="""
, l AS (SELECT word_id, source = 'system' AS hidden, text = 'click' AS by_speaker, word_id % 3 = 0 AS by_range, word_id % 5 = 0 AS echo FROM words),
s AS (SELECT *, CASE WHEN NOT hidden THEN 'shown' WHEN by_speaker THEN 'kept_by_speaker' WHEN by_range THEN 'kept' ELSE 'hidden' END AS state FROM l)
SELECT *, state = 'hidden' AND NOT echo AS can_keep, state = 'kept' AS can_release FROM s"""))
def line_keep(spark, sf_dir):
    k = F.col("word_id")
    return R.line_keep(T.words(spark, sf_dir).select("word_id", (F.col("source") == "system").alias("hidden"), (F.col("text") == "click").alias("by_speaker"), (k % 3 == 0).alias("by_range"), (k % 5 == 0).alias("echo")))


@query("listed_sessions", "SELECT count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS listed, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS archived FROM orders WHERE contains(lower(o_orderpriority), 'urg')")
def listed_sessions(spark, sf_dir):
    return R.listed(T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 3 == 0).alias("archived")), " URG ")


@query("expired_sessions", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND epoch_us(o_orderdate) // 1000000 < 900000000 - 2592000")
def expired_sessions(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("recording"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("archived_at"))
    return R.expired(rows, 900_000_000, 2_592_000).select("o_orderkey")


@query("touching_words", T.sql(W, S, body="SELECT w.* FROM words w WHERE EXISTS (SELECT 1 FROM segments s WHERE s.session_id = w.session_id AND s.source = w.source AND w.start_ms <= s.end_ms AND s.start_ms <= w.end_ms)"))
def touching_words(spark, sf_dir):
    return R.touching_words(T.words(spark, sf_dir), T.segments(spark, sf_dir))


@query("allowed_candidates", T.sql(W, body="""
, c AS (SELECT DISTINCT session_id, source, text AS name FROM words)
SELECT * FROM c WHERE source = 'mic' OR session_id % 2 = 1 OR name IN ('click', 'view')"""))
def allowed_candidates(spark, sf_dir):
    """The system end of even sessions has two known attendees; that of odd ones also an unknown."""
    rows = T.words(spark, sf_dir).select("session_id", "source", F.col("text").alias("name")).distinct()
    meeting = rows.select("session_id").distinct().select("session_id", F.lit("system").alias("source"), F.array(F.lit("Click"), F.lit(" VIEW ")).alias("known"), (F.col("session_id") % 2).cast("int").alias("unknown"))
    return R.allowed_candidates(rows, meeting)


@query("group_faults", T.sql(S, body="""
SELECT seg_id AS group_id, CASE WHEN end_ms <= start_ms THEN 'empty' WHEN seg_id % 12 = 0 THEN 'turns'
  WHEN max(end_ms) OVER (PARTITION BY session_id, source ORDER BY start_ms, end_ms, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start_ms THEN 'overlap' END AS fault FROM segments"""))
def group_faults(spark, sf_dir):
    a, b = F.col("start_ms"), F.col("end_ms")
    rows = T.segments(spark, sf_dir).select("session_id", "source", F.col("seg_id").alias("group_id"), "start_ms", "end_ms", F.when(F.col("seg_id") % 12 == 0, F.array(a + 20, a + 10)).otherwise(F.array(a, b)).alias("turns"))
    return R.group_faults(rows).select("group_id", "fault")


@query("seams_between", T.sql(W, body="""
, n AS (SELECT session_id, word_id AS line_id, start_ms, lead(start_ms) OVER (PARTITION BY session_id ORDER BY start_ms, word_id) AS next_ms FROM words),
s AS (SELECT DISTINCT session_id, p + 500 AS seam_ms FROM ev)
SELECT session_id, line_id, seam_ms FROM n JOIN s USING (session_id) WHERE start_ms < seam_ms AND seam_ms <= next_ms"""))
def seams_between(spark, sf_dir):
    seams = T.events(spark, sf_dir).select("session_id", (F.col("p") + 500).alias("start_ms")).distinct()
    return R.seams_between(T.words(spark, sf_dir).select("session_id", F.col("word_id").alias("line_id"), "start_ms"), seams)


@query("speaker_count", T.sql(W, body="SELECT word_id, coalesce(CASE WHEN word_id % 4 = 0 THEN 2 END, CASE WHEN source = 'system' AND word_id % 3 > 0 THEN CAST(word_id % 3 AS INTEGER) END) AS num_speakers FROM words"))
def speaker_count(spark, sf_dir):
    k = F.col("word_id")
    return R.speaker_count(T.words(spark, sf_dir).withColumn("asked", F.when(k % 4 == 0, 2)).withColumn("remote", (k % 3).cast("int"))).select("word_id", "num_speakers")


@query("extension_filter", "SELECT page_id, regexp_extract(lower(url), '\\.([^./]+)$', 1) IN ('com', 'org') AS wanted FROM (SELECT page_id, split_part(url, '/', 3) AS url FROM pages)")
def extension_filter(spark, sf_dir):
    rows = T.table(spark, sf_dir, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("name"))
    return rows.select("page_id", R.extension_matches(F.col("name"), [".COM", "org"]).alias("wanted"))


@query("calendar_choice", "SELECT c_custkey, 1 + (c_custkey % 2) AS n_remote, c_custkey % 2 = 1 AS own_missing, CAST(ceil(c_custkey % 1000 / 60.0) AS BIGINT) AS minutes FROM customer")
def calendar_choice(spark, sf_dir):
    k = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_name"), F.when(k % 2 == 0, " mE ").otherwise("Other")).alias("attendees"), (k % 1000).alias("overlap_s"))
    return R.calendar_choice(rows, "Me").select("c_custkey", F.size("remote").cast("long").alias("n_remote"), "own_missing", "minutes")


@query("reference_points", T.sql(W, body="""
, pts AS (SELECT session_id, p AS at_ms, event_id % 17 AS delay, value AS gain FROM ev),
m AS (SELECT word_id, pts.*, start_ms + greatest(end_ms - start_ms, 0) // 2 AS mid FROM words w JOIN pts USING (session_id)),
n AS (SELECT *, CASE WHEN at_ms <= mid THEN 'before' ELSE 'after' END AS side FROM m WHERE abs(at_ms - mid) <= 180000),
r AS (SELECT *, row_number() OVER (PARTITION BY word_id, side ORDER BY abs(at_ms - mid), at_ms, delay, gain) AS k FROM n),
g AS (SELECT word_id, side, list_sort(list(delay)) AS d, list_sort(list(gain)) AS g, count(*) AS n FROM r WHERE k <= 3 GROUP BY ALL)
SELECT word_id, side, d[n // 2 + 1] AS delay, g[n // 2 + 1] AS gain, n FROM g"""))
def reference_points(spark, sf_dir):
    points = T.events(spark, sf_dir).select("session_id", F.col("p").alias("at_ms"), (F.col("event_id") % 17).alias("delay"), F.col("value").alias("gain"))
    return R.reference_points(T.words(spark, sf_dir), points)


@query("cluster_for_range", T.sql(S, body="""
, q AS (SELECT session_id, source, event_id AS request_id, p AS start_ms, p + 700 AS end_ms FROM ev),
l AS (SELECT session_id, source, start_ms, start_ms + 700 AS end_ms, min(cluster) AS x FROM segments WHERE seg_id % 3 = 0 GROUP BY ALL),
n AS (SELECT request_id, s.cluster FROM q JOIN segments s ON s.session_id = q.session_id AND s.source = q.source AND q.start_ms <= s.end_ms AND s.start_ms <= q.end_ms
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY greatest(least(q.end_ms, s.end_ms) - greatest(q.start_ms, s.start_ms), 0) DESC, s.start_ms, s.cluster) = 1)
SELECT q.request_id, coalesce(l.x, n.cluster) AS cluster FROM q LEFT JOIN l USING (session_id, source, start_ms, end_ms) LEFT JOIN n USING (request_id)"""))
def cluster_for_range(spark, sf_dir):
    p = F.col("p")
    requests = T.events(spark, sf_dir).select("session_id", "source", F.col("event_id").alias("request_id"), p.alias("start_ms"), (p + 700).alias("end_ms"))
    segments = T.segments(spark, sf_dir)
    lines = segments.where("seg_id % 3 = 0").select("session_id", "source", "start_ms", (F.col("start_ms") + 700).alias("end_ms"), "cluster")
    return R.cluster_for_range(requests, lines, segments)


@query("all_assignments", T.sql(S, body="SELECT DISTINCT session_id, source, cluster, CASE WHEN cluster < 3 THEN 'p' || cluster END AS best_candidate, CASE WHEN cluster = 1 THEN 'p1' END AS speaker FROM segments"))
def all_assignments(spark, sf_dir):
    segments = T.segments(spark, sf_dir)
    keys = segments.select("session_id", "source", "cluster").distinct()
    name = F.concat(F.lit("p"), F.col("cluster").cast("string"))
    return R.all_assignments(segments, keys.where("cluster < 3").withColumn("best_candidate", name), keys.where("cluster = 1").withColumn("speaker", name))


@query("clipped_stretches", f"""WITH {PIECES_SQL}, c AS (SELECT o_custkey, greatest(offset_ms, 60000) AS a, least(offset_ms + length_ms, 200000) AS b, offset_ms FROM pieces)
SELECT o_custkey, a - 60000 AS offset_ms, b - a AS length_ms, a - offset_ms AS skipped_ms FROM c WHERE b > a""")
def clipped_stretches(spark, sf_dir):
    return R.clipped_stretches(_pieces(spark, sf_dir), 60000, 200000, ("o_custkey",))


@query("pair_scores", """
WITH s AS (SELECT l_suppkey % 10 AS person, l_partkey % 10 AS rival, l_discount * 10 AS score FROM lineitem WHERE l_suppkey % 10 <> l_partkey % 10), m AS (SELECT person, rival, median(score) AS m FROM s GROUP BY ALL)
SELECT least(person, rival) AS a, greatest(person, rival) AS b, round(max(m), 6) AS score FROM m GROUP BY ALL HAVING max(m) >= 0.4""")
def pair_scores(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("person"), (F.col("l_partkey") % 10).alias("rival"), (F.col("l_discount") * 10).alias("score")).where("person <> rival")
    return R.pair_scores(rows, 0.5).withColumn("score", F.round("score", 6))


@query("recorded_duration", """
WITH t AS (SELECT l_orderkey AS session_id, max(CAST(floor(l_extendedprice) AS BIGINT) // 16) AS length_ms, max(CASE WHEN l_orderkey % 2 = 0 THEN 500 END) AS a, max(CASE WHEN l_orderkey % 3 = 0 THEN 3000 END) AS b FROM lineitem GROUP BY ALL)
SELECT session_id, length_ms, greatest(least(length_ms, coalesce(b, length_ms)) - coalesce(a, 0), 0) AS listed_ms FROM t""")
def recorded_duration(spark, sf_dir):
    k = F.col("l_orderkey")
    return R.recorded_duration(T.table(spark, sf_dir, "lineitem").select(k.alias("session_id"), F.floor("l_extendedprice").alias("samples"), F.when(k % 2 == 0, F.lit(500).cast("long")).alias("span_start"), F.when(k % 3 == 0, F.lit(3000).cast("long")).alias("span_end")))


@query("sessions_since", f"WITH {T.SAMPLES_SQL}, h AS (SELECT DISTINCT name, session FROM samples WHERE session <> 3), x AS (SELECT name, max(session) AS m FROM h GROUP BY ALL) SELECT s.sample_no, m - h.session AS since FROM samples s LEFT JOIN h USING (name, session) LEFT JOIN x USING (name)")
def sessions_since(spark, sf_dir):
    rows = T.samples(spark, sf_dir)
    return R.sessions_since(rows, rows.select("name", "session").distinct().where("session <> 3").withColumn("pos", F.col("session"))).select("sample_no", "since")


@query("rfc3339_times", """
WITH t AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS ms, CAST((o_orderkey % 5 - 2) * 90 AS INTEGER) AS off FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN ms END AS ms, CASE WHEN o_orderkey % 7 <> 0 THEN off END AS offset_min FROM t""")
def rfc3339_times(spark, sf_dir):
    """Printed in an offset and parsed again; every seventh is no time."""
    ms, off = F.unix_millis(F.col("o_orderdate").cast("timestamp")), ((F.col("o_orderkey") % 5 - 2) * 90).cast("int")
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "yesterday").otherwise(R.wallclock_text(ms, off)).alias("s"))
    at, minutes = R.rfc3339(F.col("s"))
    return rows.select("o_orderkey", at.alias("ms"), minutes.alias("offset_min"))


@query("month_grid", """
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS first FROM orders), d AS (SELECT first, unnest(generate_series(date_trunc('week', first)::DATE, date_trunc('week', last_day(first))::DATE + 6, INTERVAL 1 DAY)) AS day FROM m)
SELECT CAST(first AS VARCHAR) AS first, count(*) AS n, CAST(CAST(min(day) AS DATE) AS VARCHAR) AS start FROM d GROUP BY ALL""")
def month_grid(spark, sf_dir):
    """F17."""
    months = T.table(spark, sf_dir, "orders").select(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date").alias("first")).distinct()
    return months.select(F.col("first").cast("string").alias("first"), F.explode(R.month_days(F.col("first"))).alias("day")).groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("start"))


@query("session_titles", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Recording ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') ELSE o_orderpriority END AS shown FROM orders")
def session_titles(spark, sf_dir):
    """F18, F28."""
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderdate").cast("timestamp").alias("started"))
    return R.title(rows).select("o_orderkey", "shown")


@query("job_queue", "SELECT o_custkey AS session_id, min(o_orderkey) AS job_id, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS position, CASE WHEN row_number() OVER (ORDER BY min(o_orderkey)) = 1 THEN 'running' ELSE 'waiting' END AS state FROM orders GROUP BY o_custkey")
def job_queue(spark, sf_dir):
    """K9."""
    return R.queue_positions(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("job_id")))
