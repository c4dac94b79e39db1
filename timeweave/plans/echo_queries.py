"""Queries of the echo passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import echo as E
from timeweave.plans.catalogue import query
from timeweave.sources import tables as T


def _mic(spark, sf_dir):
    return T.words(spark, sf_dir).where("source = 'mic'")


def _spans(spark, sf_dir, k):
    return T.kept_ranges(spark, sf_dir).where(F.col("range_id") % 3 == k).select("session_id", "start_ms", "end_ms")


def _leads(spark, sf_dir):
    """Each event leads 300 ms."""
    spread = T.events(spark, sf_dir).select("session_id", F.explode(F.expr("sequence(p DIV 10, p DIV 10 + 29)")).alias("frame"), (F.col("event_id") % 5).alias("k"))
    lead = F.when(F.max("k") == 4, "mic").when(F.max("k") == 3, "both").otherwise("system")
    return spread.groupBy("session_id", "frame").agg(lead.alias("lead"))


@query("echo_leads", T.sql(T.WORDS_SQL, T.KEPT_SQL, body="""
, x AS (SELECT session_id, p // 10 + unnest(range(30)) AS frame, event_id % 5 AS k FROM ev),
l AS (SELECT session_id, frame, CASE max(k) WHEN 4 THEN 'mic' WHEN 3 THEN 'both' ELSE 'system' END AS lead FROM x GROUP BY session_id, frame),
m AS (SELECT * FROM words WHERE source = 'mic'),
n AS (SELECT m.session_id, word_id, start_ms, end_ms, count(*) AS n, count(*) FILTER (lead = 'system') AS s FROM m JOIN l ON l.session_id = m.session_id AND l.frame BETWEEN start_ms // 10 AND greatest(start_ms, end_ms - 1) // 10 GROUP BY ALL)
SELECT session_id, word_id FROM n WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.range_id % 3 = 0 AND k.session_id = n.session_id AND k.start_ms < n.end_ms AND n.start_ms < k.end_ms)
AND s >= n * CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.range_id % 3 = 1 AND k.session_id = n.session_id AND k.start_ms < n.end_ms AND n.start_ms < k.end_ms) THEN 0.4 ELSE 0.7 END"""))
def echo_leads(spark, sf_dir):
    """M18's last pass, with kept ranges as the room's spans and as turns of echoing voices."""
    return E.lead_pass(_mic(spark, sf_dir), _leads(spark, sf_dir), _spans(spark, sf_dir, 0), _spans(spark, sf_dir, 1))


@query("echo_words")
def echo_words(spark, sf_dir):
    """Evidence, texts alone and leads, one after the other."""
    words = T.words(spark, sf_dir)
    evidence = _mic(spark, sf_dir).select("session_id", "word_id", (F.col("word_id") % 10 / 10.0).alias("excess"), (F.col("word_id") % 7 / 7.0).alias("correlation"))
    return E.echo_words(words, _spans(spark, sf_dir, 0), _spans(spark, sf_dir, 1), evidence, None, _leads(spark, sf_dir))
