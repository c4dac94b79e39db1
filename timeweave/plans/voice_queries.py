"""Queries on voices, proposals and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import voices as N
from timeweave.plans.catalogue import query
from timeweave.plans.signal_queries import COARSE, LEAD_SQL, _coarse, _leads
from timeweave.sources import tables as T

W, S = T.WORDS_SQL, T.SEGMENTS_SQL


@query("remote_similarity", f"""WITH {T.SAMPLES_SQL}, c AS (SELECT session, CASE WHEN sample_no % 2 = 0 THEN 'mic' ELSE 'system' END AS source, sample_no % 4 // 2 AS cluster, v FROM samples),
p AS (SELECT session, source, cluster, i, sum(x / n) AS s FROM (SELECT session, source, cluster, unnest(v) AS x, unnest(range(len(v))) AS i, sqrt(list_inner_product(v, v)) AS n FROM c) GROUP BY ALL),
u AS (SELECT session, source, cluster, list(s ORDER BY i) AS s FROM p GROUP BY ALL), z AS (SELECT *, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS c0 FROM u)
SELECT a.session AS session_id, a.cluster AS mic_cluster, round(max(list_inner_product(a.c0, b.c0)), 6) AS similarity FROM z a JOIN z b USING (session) WHERE a.source = 'mic' AND b.source = 'system' GROUP BY ALL""")
def remote_similarity(spark, sf_dir):
    k = F.col("sample_no")
    chunks = T.samples(spark, sf_dir).select(F.col("session").alias("session_id"), F.when(k % 2 == 0, "mic").otherwise("system").alias("source"), F.expr("sample_no % 4 DIV 2").alias("cluster"), "v")
    return N.remote_similarity(chunks).withColumn("similarity", F.round("similarity", 6))


@query("voice_spans", T.sql(S, COARSE, LEAD_SQL, body="""
, c AS (SELECT s.session_id, s.seg_id, s.cluster, count(*) AS led, count(*) FILTER (lead <> 'system') AS room FROM segments s JOIN leads l ON l.session_id = s.session_id AND l.frame BETWEEN s.start_ms // 2000 AND greatest(s.start_ms, s.end_ms - 1) // 2000 WHERE lead IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT *, sum(room) OVER (PARTITION BY session_id, cluster) > sum(led) OVER (PARTITION BY session_id, cluster) * 0.5 AS in_room FROM c"""))
def voice_spans(spark, sf_dir):
    return N.voice_spans(T.segments(spark, sf_dir), _leads(spark, sf_dir), least=2, frame_ms=2000)


@query("admission")
def admission(spark, sf_dir):
    """M13 on the first hundred samples against the rest."""
    rows = T.samples(spark, sf_dir)
    new = rows.select(F.col("sample_no").alias("query_id"), "name", "session", F.col("v").alias("q"))
    return N.admitted(new, rows.where("sample_no >= 100"), 0.2).select("query_id", "name", F.round("own_score", 6).alias("own_score"), F.round("rival_score", 6).alias("rival_score"), "admitted")


@query("forward_proposals", T.sql(S, body="""
, l AS (SELECT session_id, cluster, seg_id AS line_id, start_ms, seg_id % 5 = 0 AS locked, CASE WHEN seg_id % 3 = 0 THEN 'SPEAKER_01' WHEN seg_id % 7 = 0 THEN 'Ann' ELSE 'Bob' END AS speaker, seg_id % 100 / 100.0 AS new_score, seg_id % 90 / 100.0 AS old_score FROM segments),
c AS (SELECT session_id, cluster, min(end_ms) AS f FROM segments WHERE start_ms > 500000 GROUP BY ALL)
SELECT line_id, 'Ann' AS proposed FROM l JOIN c USING (session_id, cluster) WHERE start_ms >= f AND NOT locked AND speaker <> 'Ann' AND CASE WHEN speaker = 'SPEAKER_01' THEN new_score >= 0.5 ELSE round(new_score - old_score, 9) >= 0.05 END"""))
def forward_proposals(spark, sf_dir):
    k, rows = F.col("seg_id"), T.segments(spark, sf_dir)
    speaker = F.when(k % 3 == 0, "SPEAKER_01").when(k % 7 == 0, "Ann").otherwise("Bob")
    lines = rows.select("session_id", "cluster", k.alias("line_id"), "start_ms", (k % 5 == 0).alias("locked"), speaker.alias("speaker"), (k % 100).cast("decimal(9,4)").alias("n"), (k % 90).cast("decimal(9,4)").alias("o"))
    lines = lines.select("*", (F.col("n") / 100).alias("new_score"), (F.col("o") / 100).alias("old_score"))
    correction = rows.where("start_ms > 500000").groupBy("session_id", "cluster").agg(F.min("end_ms").alias("end_ms")).withColumn("speaker", F.lit("Ann"))
    return N.proposals(lines, correction, 0.5).select("line_id", "proposed")


@query("turn_cuts", T.sql(T.TURNS_SQL, body="""
, g AS (SELECT group_id, min(start_ms) AS s FROM turns GROUP BY ALL), c AS (SELECT DISTINCT group_id, t AS start_ms FROM (SELECT group_id, unnest([s, s + 2000, s + 3000, s + 2000]) AS t FROM g))
SELECT c.group_id, c.start_ms, t.speaker FROM c LEFT JOIN turns t ON t.group_id = c.group_id AND t.turn_ms = c.start_ms"""))
def turn_cuts(spark, sf_dir):
    """Cuts at two and three seconds; the turn at two keeps its name."""
    s = F.col("start_ms")
    groups = T.turns(spark, sf_dir).groupBy("group_id").agg(F.min("start_ms").alias("start_ms"), F.collect_list(F.struct(F.col("turn_ms").alias("start_ms"), "speaker")).alias("turns"))
    cut = groups.select("group_id", F.explode(N.with_cuts(F.col("turns"), s, F.array(s + 2000, s + 3000, s + 2000))).alias("t"))
    return cut.select("group_id", "t.start_ms", "t.speaker")


@query("settled_groups", T.sql(T.TURNS_SQL, body="SELECT group_id, CASE WHEN bool_and(x IS NOT NULL) AND min(x) = max(x) THEN min(x) END AS name FROM (SELECT group_id, CASE WHEN group_id % 2 = 0 THEN 'Ann' ELSE speaker END AS x FROM turns) GROUP BY ALL"))
def settled_groups(spark, sf_dir):
    speaker = F.when(F.col("group_id") % 2 == 0, "Ann").otherwise(F.col("speaker")).alias("speaker")
    groups = T.turns(spark, sf_dir).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("turn_ms", speaker))).alias("turns"))
    return groups.select("group_id", N.settled(F.col("turns")).alias("name"))


@query("first_turn_speaker", T.sql(W, body="""
, l AS (SELECT word_id AS line_id, word_id // 9 AS group_id, start_ms, text AS speaker FROM words), g AS (SELECT group_id, group_id % 4 = 0 AS first_named FROM l GROUP BY ALL)
SELECT group_id, first_named, CASE WHEN NOT first_named THEN (SELECT arg_min(speaker, (start_ms, line_id)) FROM l WHERE l.group_id = g.group_id) END AS first_speaker FROM g"""))
def first_turn_speaker(spark, sf_dir):
    lines = T.words(spark, sf_dir).select(F.col("word_id").alias("line_id"), F.expr("word_id DIV 9").alias("group_id"), "start_ms", F.col("text").alias("speaker"))
    return N.first_turn_speaker(lines, lines.select("group_id").distinct().withColumn("first_named", F.col("group_id") % 4 == 0))


@query("previous_names", T.sql(T.CORRECTIONS_SQL, body="""
, r AS (SELECT session_id, source, ordinal AS request_id, start_ms, end_ms, speaker, 1 AS cluster FROM corrections WHERE ordinal % 2 = 0), k AS (SELECT * FROM corrections WHERE ordinal % 2 = 1),
n AS (SELECT request_id, r.speaker, k.speaker AS name FROM r JOIN k USING (session_id, source) WHERE r.start_ms < k.end_ms AND k.start_ms < r.end_ms UNION SELECT request_id, speaker, 'P_guess' FROM r)
SELECT request_id, name FROM n WHERE lower(name) <> lower(speaker)"""))
def previous_names(spark, sf_dir):
    rows = T.corrections(spark, sf_dir)
    requests = rows.where("ordinal % 2 = 0").select("session_id", "source", F.col("ordinal").alias("request_id"), "start_ms", "end_ms", "speaker", F.lit(1).alias("cluster"))
    guess = requests.select("session_id", "source", "cluster").distinct().withColumn("speaker", F.lit("P_guess"))
    return N.previous_names(requests, rows.where("ordinal % 2 = 1"), guess)


@query("word_excess", T.sql(W, COARSE, body="""
, m AS (SELECT w.word_id, e, a.rms AS mic, b.rms AS sys FROM words w, (VALUES (0), (1)) t(e) JOIN coarse a ON a.session_id = w.session_id AND a.source = 'mic' AND a.frame = w.start_ms // 2000 JOIN coarse b ON b.session_id = w.session_id AND b.source = 'system' AND b.frame = a.frame - e)
SELECT word_id, round(min(x), 6) AS excess FROM (SELECT word_id, e, 0.5 * ln(greatest(sum(mic * mic), 1e-12) / greatest(sum(sys * sys), 1e-12)) - 0.1 * max(e) AS x FROM m GROUP BY word_id, e) GROUP BY word_id"""))
def word_excess(spark, sf_dir):
    frames = _coarse(spark, sf_dir)
    mic = frames.where("source = 'mic'").select("session_id", "frame", F.col("rms").alias("mic"))
    system = frames.where("source = 'system'").select("session_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("estimate"), "frame", F.col("rms").alias("system")).withColumn("frame", F.col("frame") + F.col("estimate"))
    words = T.words(spark, sf_dir).select("session_id", "word_id", F.expr("start_ms DIV 2000").alias("frame"))
    met = words.join(mic, ["session_id", "frame"]).join(system, ["session_id", "frame"]).withColumn("gain_ln", F.col("estimate") * 0.1)
    return N.word_excess(met).withColumn("excess", F.round("excess", 6))


@query("long_regions")
def long_regions(spark, sf_dir):
    """A region over each session, cut near every hundred coarse frames."""
    levels = _coarse(spark, sf_dir).where("source = 'mic'").select("session_id", "frame", "rms")
    regions = levels.groupBy("session_id").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"))
    return N.long_regions(regions, levels, 100, 10)
