"""Queries of the signal operators on level frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.functions import scalars as X
from timeweave.operators import intervals as I
from timeweave.operators import signals as G
from timeweave.plans.catalogue import query
from timeweave.sources import tables as T

W, FR = T.WORDS_SQL, T.FRAMES_SQL
#: Frames of two seconds of event time, dense enough for correlation.
COARSE = "coarse AS (SELECT session_id, source, p // 2000 AS frame, max(value) / 1000 AS rms FROM ev GROUP BY ALL)"


def _coarse(spark, sf_dir):
    return T.events(spark, sf_dir).groupBy("session_id", "source", F.expr("p DIV 2000").alias("frame")).agg((F.max("value") / 1000).alias("rms"))


@query("level_quantiles", T.sql(FR, body="""
, g AS (SELECT session_id, source, list_sort(list(rms)) AS s, count(*) AS n FROM frames GROUP BY ALL)
SELECT session_id, source, round(s[n // 2 + 1], 9) AS upper_median, round(s[least(CAST(floor(n * 0.2) AS BIGINT), n - 1) + 1], 9) AS floor_q20, round(s[CAST(floor((n - 1) * 0.8 + 0.5) AS BIGINT) + 1], 9) AS rounded_q80,
  round(greatest(s[least(n * 995 // 1000, n - 1) + 1], 0.02), 9) AS display_norm, round(least(greatest(4 * s[n // 10 + 1], 0.003), 0.03), 9) AS quiet_limit, round(0.9 * s[CAST(floor((n - 1) * 0.1 + 0.5) AS BIGINT) + 1], 9) AS shell_offset FROM g"""))
def level_quantiles(spark, sf_dir):
    """A8, A9, A10, A18, A19, A32."""
    from timeweave.operators.sequences import quiet_threshold

    v = F.collect_list("rms")
    return T.frames(spark, sf_dir).groupBy("session_id", "source").agg(
        F.round(X.upper_median(v), 9).alias("upper_median"), F.round(X.floor_quantile(v, 0.2), 9).alias("floor_q20"), F.round(X.rounded_quantile(v, 0.8), 9).alias("rounded_q80"),
        F.round(X.display_norm(v), 9).alias("display_norm"), F.round(quiet_threshold(v), 9).alias("quiet_limit"), F.round(X.rounded_quantile(v, 0.1) * 0.9, 9).alias("shell_offset"),
    )


@query("activity_threshold", T.sql(FR, body="""
, p AS (SELECT session_id, source, quantile_disc(rms, 0.95) AS p95 FROM frames GROUP BY ALL)
SELECT session_id, source, p95, CASE WHEN p95 > 1e-5 THEN greatest(p95 * 0.1, 1e-4) END AS threshold FROM p"""))
def activity_threshold(spark, sf_dir):
    return G.activity_threshold(T.frames(spark, sf_dir), ("session_id", "source"))


LAGS_SQL = """pairs AS (SELECT m.session_id, l.lag, m.rms AS mic, s.rms AS system FROM coarse m, (VALUES (-2), (-1), (0), (1), (2), (3)) l(lag) JOIN coarse s ON s.session_id = m.session_id AND s.frame + l.lag = m.frame WHERE m.source = 'mic' AND s.source = 'system'),
c AS (SELECT session_id, lag, least(greatest(corr(ln(mic + 1e-6), ln(system + 1e-6)), -1), 1) AS r, count(*) AS n, avg(ln(greatest(mic, 1e-6)) - ln(greatest(system, 1e-6))) AS gain_ln FROM pairs GROUP BY ALL HAVING count(*) >= 20)"""


@query("lag_correlation", T.sql(COARSE, LAGS_SQL, body="SELECT session_id, lag, round(r, 6) AS r, n, round(gain_ln, 6) AS gain_ln FROM c"))
def lag_correlation(spark, sf_dir):
    return G.lag_correlations(_coarse(spark, sf_dir), (-2, -1, 0, 1, 2, 3)).select("session_id", "lag", F.round("r", 6).alias("r"), "n", F.round("gain_ln", 6).alias("gain_ln"))


@query("best_lag", T.sql(COARSE, LAGS_SQL, body="""
SELECT session_id, max(CASE WHEN r = top THEN lag END) AS best_lag, round(max(r), 6) AS r, min(CASE WHEN r >= top - 0.02 THEN lag END) AS earliest_lag FROM (SELECT *, max(r) OVER (PARTITION BY session_id) AS top FROM c WHERE r IS NOT NULL) GROUP BY session_id"""))
def best_lag(spark, sf_dir):
    return G.best_lag(G.lag_correlations(_coarse(spark, sf_dir), (-2, -1, 0, 1, 2, 3))).withColumn("r", F.round("r", 6))


@query("room_tail", T.sql(COARSE, body="""
SELECT a.session_id, a.source, a.frame, round(max(b.rms * pow(0.7, a.frame - b.frame)), 9) AS held FROM coarse a JOIN coarse b ON a.session_id = b.session_id AND a.source = b.source AND b.frame BETWEEN a.frame - 15 AND a.frame GROUP BY ALL"""))
def room_tail(spark, sf_dir):
    return G.room_tail(_coarse(spark, sf_dir), ("session_id", "source")).withColumn("held", F.round("held", 9))


@query("leak_gains", T.sql(COARSE, body="""
, ratios AS (SELECT m.session_id, m.frame, m.rms / greatest(s.rms, 1e-9) AS ratio FROM coarse m JOIN coarse s ON m.session_id = s.session_id AND m.frame = s.frame WHERE m.source = 'mic' AND s.source = 'system'),
whole AS (SELECT session_id, list_sort(list(ratio)) AS s, count(*) AS n, max(frame) AS last FROM ratios GROUP BY ALL),
steps AS (SELECT session_id, unnest(range(0, last + 1, 50)) AS start, s[least(CAST(floor(n * 0.2) AS BIGINT), n - 1) + 1] AS overall FROM whole),
near AS (SELECT t.session_id, t.start, list_sort(list(ratio)) AS s, count(*) AS n FROM steps t JOIN ratios r ON r.session_id = t.session_id AND r.frame >= t.start - 120 AND r.frame < t.start + 120 GROUP BY ALL)
SELECT t.session_id, t.start, round(CASE WHEN n.n >= 20 THEN n.s[least(CAST(floor(n.n * 0.2) AS BIGINT), n.n - 1) + 1] ELSE overall END, 6) AS gain FROM steps t LEFT JOIN near n USING (session_id, start)"""))
def leak_gains(spark, sf_dir):
    ratios = G.paired(_coarse(spark, sf_dir)).select("session_id", "frame", (F.col("mic") / F.greatest("system", F.lit(1e-9))).alias("ratio"))
    return G.leak_gains(ratios, 50, 120, 20).withColumn("gain", F.round("gain", 6))


LEAD_SQL = """mic AS (SELECT session_id, frame, rms AS mic FROM coarse WHERE source = 'mic'),
sys AS (SELECT session_id, frame + 1 AS frame, rms FROM coarse WHERE source = 'system'),
held AS (SELECT m.session_id, m.frame, m.mic, coalesce(max(s.rms * pow(0.7, m.frame - s.frame)), 0) AS held FROM mic m LEFT JOIN sys s ON s.session_id = m.session_id AND s.frame BETWEEN m.frame - 15 AND m.frame GROUP BY ALL),
leads AS (SELECT session_id, frame, CASE WHEN l AND a THEN 'both' WHEN l THEN 'mic' WHEN a THEN 'system' END AS lead FROM (SELECT *, mic > 3.0 * 0.004 AND mic >= pow(10, 8.0 / 20) * (0.5 * held + 0.004) AS l, held >= 0.02 AS a FROM held))"""


def _leads(spark, sf_dir):
    return G.frame_lead(_coarse(spark, sf_dir), 1, 0.02, 0.5, 0.004).select("session_id", "frame", "lead")


@query("frame_lead", T.sql(COARSE, LEAD_SQL, body="SELECT * FROM leads"))
def frame_lead(spark, sf_dir):
    return _leads(spark, sf_dir)


_MAJORITY = "CASE WHEN mic + system + \"both\" = 0 THEN NULL WHEN \"both\" >= mic AND \"both\" >= system THEN 'both' WHEN mic > system THEN 'mic' ELSE 'system' END AS lead"


@query("lead_majority", T.sql(COARSE, LEAD_SQL, body=f"""
, c AS (SELECT session_id, frame // 20 AS stretch, count(*) FILTER (lead = 'mic') AS mic, count(*) FILTER (lead = 'system') AS system, count(*) FILTER (lead = 'both') AS "both" FROM leads GROUP BY ALL)
SELECT *, {_MAJORITY} FROM c"""))
def lead_majority(spark, sf_dir):
    return G.lead_majority(_leads(spark, sf_dir).withColumn("stretch", F.expr("frame DIV 20")), ("session_id", "stretch"))


@query("word_leads", T.sql(W, COARSE, LEAD_SQL, body=f"""
, c AS (SELECT w.session_id, w.word_id, count(*) FILTER (lead = 'mic') AS mic, count(*) FILTER (lead = 'system') AS system, count(*) FILTER (lead = 'both') AS "both" FROM words w JOIN leads l ON l.session_id = w.session_id AND l.frame BETWEEN w.start_ms // 2000 AND greatest(w.start_ms, w.end_ms - 1) // 2000 GROUP BY ALL)
SELECT *, {_MAJORITY} FROM c"""))
def word_leads(spark, sf_dir):
    return G.word_leads(T.words(spark, sf_dir), _leads(spark, sf_dir), 2000)


@query("calibration_windows", T.sql(COARSE, body="""
, q AS (SELECT m.session_id, m.frame, m.rms AS mic, s.rms AS system FROM coarse m JOIN coarse s ON m.session_id = s.session_id AND m.frame = s.frame WHERE m.source = 'mic' AND s.source = 'system'),
w AS (SELECT session_id, frame // 40 AS win, count_if(system >= 0.01) AS active, count(*) AS n, corr(ln(mic + 1e-6), ln(system + 1e-6)) AS r FROM q GROUP BY ALL)
SELECT session_id, win, active, n, coalesce(active * 2 >= n AND r >= 0.1, false) AS kept FROM w"""))
def calibration_windows(spark, sf_dir):
    return G.calibration_windows(G.paired(_coarse(spark, sf_dir)), 40, least_r=0.1).select("session_id", "win", "active", "n", "kept")


@query("delay_at_frame", T.sql(COARSE, body="""
, f AS (SELECT session_id, frame FROM coarse WHERE source = 'mic'), pts AS (SELECT DISTINCT session_id, event_id % 1200 AS pos, CAST(event_id % 9 AS INTEGER) AS delay FROM events_ WHERE event_id % 401 = 0),
c AS (SELECT f.session_id, f.frame, pts.delay, abs(pos - f.frame) AS d, pos FROM f JOIN pts ON pts.session_id = f.session_id AND abs(pos - f.frame) <= 60)
SELECT f.session_id, f.frame, coalesce(c.delay, 5) AS delay FROM f LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session_id, frame ORDER BY d, pos) = 1) c USING (session_id, frame)""").replace("events_", "ev"))
def delay_at_frame(spark, sf_dir):
    points = T.events(spark, sf_dir).where("event_id % 401 = 0").select("session_id", (F.col("event_id") % 1200).alias("at"), (F.col("event_id") % 9).cast("int").alias("delay")).distinct()
    return G.nearest_point(_coarse(spark, sf_dir).where("source = 'mic'").select("session_id", "frame"), points, 60, 5)


@query("track_mix", T.sql(FR, body="SELECT session_id, frame, round(least(greatest(sum(rms), -1), 1), 9) AS mixed FROM frames GROUP BY ALL"))
def track_mix(spark, sf_dir):
    return G.mix_tracks(T.frames(spark, sf_dir)).withColumn("mixed", F.round("mixed", 9))


@query("level_buckets", T.sql(body="SELECT session_id, source, p // 50 AS bucket, round(max(abs(value / 1000)), 9) AS peak, round(sqrt(avg(value / 1000 * value / 1000)), 9) AS rms FROM ev GROUP BY ALL"))
def level_buckets(spark, sf_dir):
    rows = T.events(spark, sf_dir).select("session_id", "source", F.col("p").alias("pos"), (F.col("value") / 1000).alias("sample"))
    return G.level_buckets(rows, ("session_id", "source"), 50).select("session_id", "source", "bucket", F.round("peak", 9).alias("peak"), F.round("rms", 9).alias("rms"))
