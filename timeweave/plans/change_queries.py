"""Queries of changes to sessions and speaker stores, and of the sinks that write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import changes as C
from timeweave.plans.catalogue import query
from timeweave.session import own_folder
from timeweave.sources import files
from timeweave.sources import tables as T

_STORE = "st AS (SELECT name, sample_no, CASE WHEN sample_no % 11 = 0 THEN 1000000 + sample_no * 20000 END AS pruned_at, CASE WHEN sample_no % 11 = 0 THEN 'old' END AS reason, sample_no % 13 = 0 AS kept_by_user FROM samples)"


def _store(spark, sf_dir):
    k = F.col("sample_no")
    return T.samples(spark, sf_dir).select("name", k, F.when(k % 11 == 0, 1_000_000 + k * 20_000).alias("pruned_at"), F.when(k % 11 == 0, F.lit("old")).alias("reason"), (k % 13 == 0).alias("kept_by_user"))


@query("tidied_store", f"""WITH {T.SAMPLES_SQL}, {_STORE},
a AS (SELECT name, sample_no, CASE WHEN sample_no % 3 = 0 AND pruned_at IS NULL AND NOT kept_by_user THEN 9000000 ELSE pruned_at END AS pruned_at, CASE WHEN sample_no % 3 = 0 AND pruned_at IS NULL AND NOT kept_by_user THEN 'stray' ELSE reason END AS reason, kept_by_user FROM st),
r AS (SELECT name, sample_no, CASE WHEN sample_no % 5 = 0 THEN NULL ELSE pruned_at END AS pruned_at, CASE WHEN sample_no % 5 = 0 AND pruned_at IS NOT NULL THEN NULL ELSE reason END AS reason, kept_by_user OR (sample_no % 5 = 0 AND pruned_at IS NOT NULL) AS kept_by_user FROM a)
SELECT * FROM r WHERE pruned_at IS NULL OR 9500000 - pruned_at < 2592000""")
def tidied_store(spark, sf_dir):
    """A pass removes, a user restores, old removals expire."""
    store = _store(spark, sf_dir)
    findings = store.where("sample_no % 3 = 0").select("name", "sample_no", F.lit("remove").alias("verdict"), F.lit("stray").alias("reason"))
    return C.without_expired(C.restored(C.set_aside(store, findings, 9_000_000), store.where("sample_no % 5 = 0")), 9_500_000)


@query("unlearned_samples", f"""WITH {T.SAMPLES_SQL}, g AS (SELECT 'person' || (sample_no % 10) AS name, v FROM samples WHERE sample_no % 6 = 0)
SELECT name, sample_no FROM samples s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.name = s.name AND list_inner_product(g.v, s.v) >= 0.999)""")
def unlearned_samples(spark, sf_dir):
    """What a person forgets."""
    rows = T.samples(spark, sf_dir)
    gone = rows.where("sample_no % 6 = 0").select(F.concat(F.lit("person"), F.col("sample_no") % 10).alias("name"), "v")
    return C.unlearned(rows, gone).select("name", "sample_no")


@query("corrected_lines", T.sql(T.SEGMENTS_SQL, T.CORRECTIONS_SQL, body="""
, n AS (SELECT * FROM corrections WHERE ordinal % 2 = 0 AND ordinal % 3 = 0), o AS (SELECT * FROM corrections WHERE ordinal % 3 <> 0),
k AS (SELECT o.ordinal AS oo, n.ordinal AS nn, o.inferred AS oi, n.inferred AS ni FROM o JOIN n USING (session_id, source) WHERE (o.start_ms < n.end_ms AND n.start_ms < o.end_ms) OR (o.start_ms = n.start_ms AND o.end_ms = n.end_ms)),
locks AS (SELECT * FROM o WHERE ordinal NOT IN (SELECT oo FROM k WHERE NOT ni OR oi) UNION ALL SELECT * FROM n WHERE ordinal NOT IN (SELECT nn FROM k WHERE ni AND NOT oi)),
m AS (SELECT s.seg_id, l.speaker, l.ordinal, l.inferred FROM segments s JOIN locks l USING (session_id, source) WHERE s.start_ms <= l.end_ms AND l.start_ms <= s.end_ms AND 2 * greatest(least(s.end_ms, l.end_ms) - greatest(s.start_ms, l.start_ms), 0) >= s.end_ms - s.start_ms),
b AS (SELECT seg_id, arg_max(speaker, ordinal) AS name, NOT arg_max(inferred, ordinal) AS locked FROM m GROUP BY seg_id)
SELECT session_id, source, seg_id AS line_id, coalesce(name, 'S' || cluster) AS speaker, coalesce(locked, false) AS locked FROM segments LEFT JOIN b USING (seg_id)"""))
def corrected_lines(spark, sf_dir):
    """Requests take their ranges, lines are rendered again."""
    rows = T.corrections(spark, sf_dir)
    lines = T.segments(spark, sf_dir).select("session_id", "source", F.col("seg_id").alias("line_id"), "start_ms", "end_ms", F.concat(F.lit("S"), "cluster").alias("speaker"))
    return C.corrected(lines, rows.where("ordinal % 3 <> 0"), rows.where("ordinal % 2 = 0 AND ordinal % 3 = 0"))[1].select("session_id", "source", "line_id", "speaker", "locked")


@query("changed_spans", """
WITH s AS (SELECT o_orderkey AS k, o_custkey % 1000 AS a, o_custkey % 1000 + 5000 AS b FROM orders WHERE o_orderkey % 3 = 0), q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 7000 END AS a, CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_custkey % 5000 END AS b FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT o_orderkey AS k, 6000 AS n FROM orders WHERE o_orderkey % 5 <> 0),
m AS (SELECT k, s.a AS oa, s.b AS ob, q.a AS na, q.b AS nb, q.k IS NOT NULL AS asked, coalesce(n, 0) AS n FROM s FULL JOIN (SELECT *, k AS kk FROM q) q USING (k) LEFT JOIN r USING (k)),
x AS (SELECT *, asked AND coalesce(na >= nb OR (n > 0 AND (coalesce(na, 0) >= n OR nb > n)), coalesce(n > 0 AND coalesce(na, 0) >= n, false), false) AS refused FROM m)
SELECT k AS session_id, CASE WHEN asked AND NOT refused THEN na ELSE oa END AS start_ms, CASE WHEN asked AND NOT refused THEN nb ELSE ob END AS end_ms, refused FROM x WHERE refused OR CASE WHEN asked AND NOT refused THEN na ELSE oa END IS NOT NULL OR CASE WHEN asked AND NOT refused THEN nb ELSE ob END IS NOT NULL""")
def changed_spans(spark, sf_dir):
    """D5."""
    o, k, c = T.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    spans = o.where(k % 3 == 0).select(k.alias("session_id"), (c % 1000).alias("start_ms"), (c % 1000 + 5000).alias("end_ms"))
    requests = o.where(k % 2 == 0).select(k.alias("session_id"), F.when(k % 4 != 0, c % 7000).alias("start_ms"), F.when(k % 4 >= 2, c % 5000).alias("end_ms"))
    return C.changed_spans(spans, requests, o.where(k % 5 != 0).select(k.alias("session_id"), F.lit(6000).alias("recorded_ms")))


@query("changed_details", """
WITH d AS (SELECT c_custkey AS k, c_mktsegment AS title, [c_name, lower(c_name), ' ' || c_mktsegment] AS remote FROM customer WHERE c_custkey % 2 = 0),
q AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE ' About ' || c_custkey || ' ' END AS title, CASE WHEN c_custkey % 5 = 0 THEN ['Ann', 'ann ', '', 'Bob'] END AS remote FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT k, coalesce(trim(q.title), d.title) AS title, coalesce(q.remote, d.remote, []) AS remote, d.title IS NOT NULL AS had FROM d FULL JOIN q USING (k)),
u AS (SELECT k, title, had, list_filter(list_transform(remote, lambda x: trim(x)), lambda x, i: x <> '' AND list_position(list_transform(remote, lambda y: lower(trim(y))), lower(x)) = i) AS people FROM m)
SELECT k AS session_id, title, array_to_string(people, '|') AS remote FROM u WHERE had OR title <> '' OR len(people) > 0""")
def changed_details(spark, sf_dir):
    """D13."""
    c, k = T.table(spark, sf_dir, "customer"), F.col("c_custkey")
    details = c.where(k % 2 == 0).select(k.alias("session_id"), F.lit(1).alias("format_version"), F.col("c_mktsegment").alias("title"), F.array("c_name", F.lower("c_name"), F.concat(F.lit(" "), "c_mktsegment")).alias("remote"))
    people = F.array(*map(F.lit, ("Ann", "ann ", "", "Bob")))
    requests = c.where(k % 3 == 0).select(k.alias("session_id"), F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit(" About "), k.cast("string"), F.lit(" "))).alias("title"), F.when(k % 5 == 0, people).alias("remote"))
    return C.changed_details(details, requests).select("session_id", "title", F.array_join("remote", "|").alias("remote"))


@query("done_sessions", """
WITH q AS (SELECT o_custkey AS k, arg_max(CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'undone' ELSE 'delete' END, o_orderkey) AS action FROM orders GROUP BY ALL)
SELECT c_custkey AS session_id, CASE action WHEN 'done' THEN true WHEN 'undone' THEN false ELSE c_custkey % 2 = 0 END AS done FROM customer LEFT JOIN q ON k = c_custkey WHERE action IS NULL OR action <> 'delete'""")
def done_sessions(spark, sf_dir):
    """D14."""
    sessions = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 2 == 0).alias("done"))
    action = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "undone").otherwise("delete")
    return C.done_sessions(sessions, T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("at"), action.alias("action")))


@query("split_parts", T.sql(T.WORDS_SQL, body="""
, t AS (SELECT session_id, source, max(end_ms) * 16 AS samples FROM words GROUP BY ALL),
p AS (SELECT session_id, source, part, CASE part WHEN 0 THEN least(samples, 16000000) ELSE greatest(samples - 16000000, 0) END AS samples FROM t, (VALUES (0), (1)) x(part))
SELECT session_id, part + 1 AS part, 1000000 AS at_ms, max(samples) AS samples FROM p GROUP BY ALL"""))
def split_parts(spark, sf_dir):
    """Lineage and lengths of the parts of every session, cut at 1,000 s."""
    words = T.words(spark, sf_dir)
    tracks = words.groupBy("session_id", "source").agg((F.max("end_ms") * 16).alias("samples"))
    return C.split_session(words, T.kept_ranges(spark, sf_dir), tracks, 1_000_000)[3]


@query("split_refusals", """
SELECT o_orderkey AS session_id, CASE WHEN o_orderstatus <> 'O' THEN 'not an unprocessed recording' WHEN o_custkey % 4000 < 1000 OR o_custkey % 4000 + 1000 > 4000 THEN 'a second must be left on each side' END AS refused FROM orders""")
def split_refusals(spark, sf_dir):
    """Which splits may be made."""
    state = F.when(F.col("o_orderstatus") == "O", "recorded").otherwise("processed")
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), state.alias("state"), F.lit(4000).alias("recorded_ms"), (F.col("o_custkey") % 4000).alias("cut_ms"))
    return C.split_refusals(rows).select("session_id", "refused")


_PIECES = """WITH p AS (SELECT o_custkey AS merge_id, o_orderkey AS piece, CASE WHEN o_custkey % 7 = 0 THEN o_orderpriority ELSE 'f' END AS folder, CASE WHEN o_custkey % 5 = 0 AND o_orderstatus = 'P' THEN 'processed' ELSE 'recorded' END AS state,
  epoch_us(o_orderdate) // 1000000 AS start_s, CAST(floor(o_totalprice) AS BIGINT) * 8000 AS samples FROM orders)"""


def _pieces(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("merge_id"), F.col("o_orderkey").alias("piece"), F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderpriority")).otherwise("f").alias("folder"),
        F.when((F.col("o_custkey") % 5 == 0) & (F.col("o_orderstatus") == "P"), "processed").otherwise("recorded").alias("state"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start_s"), (F.floor("o_totalprice") * 8000).alias("samples"),
    )


@query("merge_refusals", _PIECES + """,
m AS (SELECT *, coalesce(max(start_s + samples / 16000) OVER (PARTITION BY merge_id ORDER BY start_s, samples ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start_s, false) AS meets FROM p)
SELECT merge_id, CASE WHEN count(*) < 2 THEN 'two recordings at least' WHEN count(DISTINCT folder) > 1 THEN 'not in one folder' WHEN bool_or(state <> 'recorded') THEN 'not all unprocessed' WHEN bool_or(meets) THEN 'they overlap' END AS refused FROM m GROUP BY merge_id""")
def merge_refusals(spark, sf_dir):
    """Which merges may be made."""
    return C.merge_refusals(_pieces(spark, sf_dir))


@query("merge_placements", _PIECES + " SELECT merge_id, piece, CAST(coalesce(sum(samples + 16000) OVER (PARTITION BY merge_id ORDER BY start_s, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM p")
def merge_placements(spark, sf_dir):
    """Where pieces start in the merged recording."""
    return C.placements(_pieces(spark, sf_dir)).select("merge_id", "piece", "offset")


@query("joined_tracks", """
WITH s AS (SELECT label AS merge_id, vec_id AS piece, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings),
o AS (SELECT label AS merge_id, vec_id AS piece, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * (64 + 16000) AS off FROM embeddings)
SELECT merge_id, off + i AS pos, CAST(x AS DOUBLE) AS sample FROM s JOIN o USING (merge_id, piece) WHERE x <> 0""")
def joined_tracks(spark, sf_dir):
    """Tracks of 64 samples with seams of silence, joined in blocks; what isn't silence."""
    rows = T.table(spark, sf_dir, "embeddings")
    pieces = rows.select(F.col("label").alias("merge_id"), F.col("vec_id").alias("piece"), F.col("vec_id").alias("start_s"), F.lit(64).cast("long").alias("samples"))
    blocks = rows.select(F.col("label").alias("merge_id"), F.col("vec_id").alias("piece"), F.lit("mic").alias("source"), F.lit(0).cast("long").alias("block"), F.col("embedding").alias("samples"))
    joined = C.joined_track(blocks, C.placements(pieces)).select("merge_id", "block", F.posexplode("samples").alias("i", "x"))
    return joined.where("x <> 0").select("merge_id", (F.col("block") * 16_384 + F.col("i")).alias("pos"), F.col("x").cast("double").alias("sample"))


@query("stage_metadata", T.sql(T.WORDS_SQL, body="""
, i AS (SELECT session_id, source AS artifact, sha256(string_agg(text || ' ' || word_id, chr(10) ORDER BY text || ' ' || word_id)) AS h FROM words GROUP BY ALL)
SELECT session_id, max(h) FILTER (artifact = 'mic') AS mic, max(h) FILTER (artifact = 'system') AS system, '{"model":"m"}' AS settings FROM i GROUP BY session_id"""))
def stage_metadata(spark, sf_dir):
    """Hashes of each session's tracks as one stage's input and output."""
    rows = T.words(spark, sf_dir).select("session_id", F.col("source").alias("artifact"), F.concat_ws(" ", "text", "word_id").alias("content"))
    found = C.stage_metadata(rows.where("artifact = 'mic'"), rows.where("artifact = 'system'"), F.struct(F.lit("m").alias("model")))
    return found.select("session_id", F.col("inputs")["mic"].alias("mic"), F.col("outputs")["system"].alias("system"), "settings")


@query("speaker_store", f"WITH {T.SAMPLES_SQL} SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY sample_no) - 1 AS INTEGER) AS sample_no, 's' || session AS session, CASE WHEN sample_no % 2 = 0 THEN 'mic' ELSE 'system' END AS source, round(v[1], 6) AS first FROM samples")
def speaker_store(spark, sf_dir):
    """Samples written as one store, which takes an older one's place, and read back."""
    path = own_folder(spark, "speakers") + "/speakers"
    rows = T.samples(spark, sf_dir)
    full = rows.select("name", "sample_no", F.col("v").alias("embedding"), F.concat(F.lit("s"), "session").alias("session"), F.when(F.col("sample_no") % 2 == 0, "mic").otherwise("system").alias("source"), F.lit(5).cast("long").alias("learned_at"), F.lit(False).alias("kept_by_user"))
    files.write_speakers(full.where("sample_no < 3"), path)
    files.write_speakers(full, path)
    return files.read_speakers(spark, path).select("name", "sample_no", "session", "source", F.round(F.col("embedding")[0], 6).alias("first"))


@query("labelled_cases", T.sql(T.SEGMENTS_SQL, body="SELECT session_id, seg_id AS line_id, seg_id % 3 AS truth, seg_id % 5 AS first FROM segments WHERE seg_id % 3 <> 1"))
def labelled_cases(spark, sf_dir):
    """Cases written with clip, words and truth, and those whose truth names their line."""
    path = own_folder(spark, "cases") + "/cases"
    rows = T.segments(spark, sf_dir).select(F.concat_ws("-", F.lit("case"), "seg_id").alias("folder"), "session_id", F.col("seg_id").alias("line_id"))
    clips = rows.select("folder", F.array(((F.col("line_id") % 5) / 32768).cast("float"), F.lit(0.5).cast("float")).alias("samples"))
    truths = rows.select("folder", "session_id", F.when(F.col("line_id") % 3 == 1, -1).otherwise(F.col("line_id")).alias("line_id"), (F.col("line_id") % 3).alias("truth"))
    files.write_cases(clips, rows.select("folder", F.lit("hello").alias("text")), truths, path)
    stored = files.read_lines(spark, f"{path}/truths", "folder STRING, session_id BIGINT, line_id BIGINT, truth BIGINT")
    sound = files.wav_samples(spark.read.parquet(f"{path}/clips"), ["folder"]).where("pos = 0").select("folder", F.col("sample").cast("long").alias("first"))
    return C.saved_cases(rows, stored).join(stored.select("folder", "truth"), "folder").join(sound, "folder").select("session_id", "line_id", "truth", "first")
