"""Queries on sessions, names, text and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.functions import scalars as X
from timeweave.operators import intervals as I
from timeweave.operators import alignment as A
from timeweave.operators import sessions as M
from timeweave.plans.catalogue import query
from timeweave.sources import tables as T

W, U = T.WORDS_SQL, T.UTTERANCES_SQL
EPOCH = "1704067200"


def _meetings(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    sessions = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("session_id"), (start + F.col("o_orderkey") % 5000).alias("start_s"), (start + F.col("o_orderkey") % 5000 + 1800).alias("end_s"))
    meetings = o.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("meeting_id"), F.concat(F.lit("m"), "o_orderkey").alias("title"), (start + F.col("o_orderkey") % 3000).alias("start_s"), (start + F.col("o_orderkey") % 3000 + 3600).alias("end_s"))
    return sessions, meetings


@query("calendar_match", """
WITH s AS (SELECT o_orderkey AS session_id, epoch_us(o_orderdate) // 1000000 + o_orderkey % 5000 AS a, epoch_us(o_orderdate) // 1000000 + o_orderkey % 5000 + 1800 AS b FROM orders WHERE o_orderkey % 7 = 0),
m AS (SELECT o_orderkey AS meeting_id, epoch_us(o_orderdate) // 1000000 + o_orderkey % 3000 AS c, epoch_us(o_orderdate) // 1000000 + o_orderkey % 3000 + 3600 AS d FROM orders WHERE o_orderkey % 11 = 0),
p AS (SELECT *, greatest(least(b, d) - greatest(a, c), 0) AS overlap_s FROM s JOIN m ON a <= d + 600 AND b >= c - 900),
r AS (SELECT *, greatest(b - a + d - c - overlap_s, 1) AS union_s FROM p WHERE (a >= c - 900 AND a <= d + 600) OR overlap_s > 0)
SELECT session_id, meeting_id, overlap_s, union_s, CAST(row_number() OVER (PARTITION BY session_id ORDER BY overlap_s::DOUBLE / union_s DESC, abs(a - c), meeting_id) AS INTEGER) AS rank FROM r""")
def calendar_match(spark, sf_dir):
    return M.calendar_match(*_meetings(spark, sf_dir))


@query("clean_text", T.sql(U, body="SELECT session_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, regexp_matches(text, '[.?!]\\s*$') AS ends FROM utt"))
def clean_text(spark, sf_dir):
    """F1, F3."""
    from timeweave.operators.sequences import ends_sentence

    return T.utterances(spark, sf_dir).select("session_id", "turn", X.clean_text(F.col("text")).alias("clean"), ends_sentence(F.col("text")).alias("ends"))


@query("join_tokens", T.sql(U, body="""
, t AS (SELECT session_id, turn, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM utt)
SELECT session_id, turn, regexp_replace(array_to_string(list_concat(w, ['.']), ' '), ' ([.,?!:;%)\\]}])', '\\1', 'g') AS joined FROM t"""))
def join_tokens(spark, sf_dir):
    """F2."""
    from timeweave.operators.sequences import join_words

    words = F.filter(F.split(X.clean_text(F.col("text")), " "), lambda x: x != "")
    return T.utterances(spark, sf_dir).select("session_id", "turn", join_words(F.concat(words, F.array(F.lit(".")))).alias("joined"))


@query("normalize_token", T.sql(U, body="""
, t AS (SELECT session_id, turn, unnest(string_split(text, ' ')) AS token FROM utt)
SELECT token, nullif(lower(regexp_replace(token, '[^\\p{L}\\p{N}]', '', 'g')), '') AS norm, count(*) AS n FROM t GROUP BY ALL"""))
def normalize_token(spark, sf_dir):
    """F4, K11."""
    tokens = T.utterances(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("norm", X.normalize_token(F.col("token")))


#: The oracle's distance counts bytes, so its letters beyond ASCII stand as upper-case ones, which no token has.
_ODD, _PLAIN = "áéíóúñüäößàèùâêîôûçœæëï", "ABCDEFGHIJKLMNOPQRSTUVW"


@query("bounded_edit_distance", f"""
WITH t AS (SELECT DISTINCT nullif(lower(regexp_replace(unnest(string_split(text, ' ')), '[^\\p{{L}}\\p{{N}}]', '', 'g')), '') AS w FROM conversations),
c AS (SELECT w, length(w) AS n, translate(w, '{_ODD}', '{_PLAIN}') AS x FROM t WHERE length(w) > 4)
SELECT a.w AS a, b.w AS b FROM c a JOIN c b ON a.w < b.w AND abs(a.n - b.n) <= 2 AND levenshtein(a.x, b.x) <= CASE WHEN least(a.n, b.n) <= 7 THEN 1 ELSE 2 END""")
def bounded_edit_distance(spark, sf_dir):
    """the pairs of all distinct tokens that match; those of up to four characters match only themselves."""
    tokens = T.utterances(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("w")).select(X.normalize_token(F.col("w")).alias("w")).where("w IS NOT NULL").distinct()
    return A.near_tokens(tokens)


@query("format_timestamps", T.sql(W, body="SELECT word_id, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS stamp, (start_ms + 5) // 10 * 10 AS rounded, start_ms + greatest(end_ms - start_ms, 0) // 2 AS mid FROM words"))
def format_timestamps(spark, sf_dir):
    """F8, F11, F23."""
    return T.words(spark, sf_dir).select("word_id", X.format_timestamp(F.col("start_ms")).alias("stamp"), X.to_10ms(F.col("start_ms")).alias("rounded"), I.midpoint().alias("mid"))


@query("parse_times", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN (o_orderkey % 99) || ':' || lpad(CAST(o_orderkey % 80 AS VARCHAR), 2, '0') WHEN 2 THEN '1:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':07.5' ELSE 'x' || o_orderkey END AS s FROM orders)
SELECT o_orderkey, s, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 1000 WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 80 < 60 THEN (o_orderkey % 99 * 60 + o_orderkey % 80) * 1000 END WHEN o_orderkey % 4 = 2 THEN (3600 + o_orderkey % 60 * 60) * 1000 + 7500 END AS ms FROM t""")
def parse_times(spark, sf_dir):
    """F12."""
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat((k % 99).cast("string"), F.lit(":"), two(k % 80))).when(k % 4 == 2, F.concat(F.lit("1:"), two(k % 60), F.lit(":07.5"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).withColumn("ms", X.parse_time(F.col("s")))


@query("vector_scalars", """
SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS square, abs(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) - 1) <= 0.001 AND len(embedding) = 64 AS unit,
  round(20 * log10(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding))), 5) AS dbfs, CAST(least(greatest(round(embedding[1]::DOUBLE * 32768), -32768), 32767) AS INTEGER) AS q0 FROM embeddings""")
def vector_scalars(spark, sf_dir):
    """F19, F21, F22, U12."""
    v = F.col("v")
    return T.table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")).select("vec_id", F.round(X.dot(v, v), 5).alias("square"), X.is_unit(v, 64).alias("unit"), F.round(X.rms_dbfs(v), 5).alias("dbfs"), X.quantize(F.get(v, F.lit(0))).alias("q0"))


@query("powerset_masks", """
SELECT vec_id, [0, 1, 2, 4, 3, 5, 6][list_position(embedding[1:7], list_max(embedding[1:7]))] AS mask FROM embeddings""")
def powerset_masks(spark, sf_dir):
    """F24."""
    return T.table(spark, sf_dir, "embeddings").select("vec_id", X.powerset_mask(F.slice("embedding", 1, 7)).alias("mask"))


@query("sessions_by_day", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, count(*) AS n FROM orders GROUP BY ALL""")
def sessions_by_day(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start_s"), F.col("o_orderstatus").alias("status"))
    return M.sessions_by_day(rows).select(F.col("day").cast("string").alias("day"), "statuses", F.size("sessions").cast("long").alias("n"))


@query("week_headings", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), w AS (SELECT day, CAST(date_trunc('week', day) AS DATE) AS week FROM d)
SELECT CAST(day AS VARCHAR) AS day, CAST(week AS VARCHAR) AS week, CAST(CASE WHEN lag(week) OVER (ORDER BY day) IS DISTINCT FROM week THEN week END AS VARCHAR) AS heading FROM w""")
def week_headings(spark, sf_dir):
    return M.week_headings(T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()).select(*[F.col(c).cast("string").alias(c) for c in ("day", "week", "heading")])


@query("frequent_speakers", T.sql(W, body="""
, t AS (SELECT session_id, text AS name, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms FROM words GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY talk_ms DESC, name) AS INTEGER) AS rank FROM t) WHERE rank <= 3"""))
def frequent_speakers(spark, sf_dir):
    return I.frequent_speakers(T.words(spark, sf_dir).withColumnRenamed("text", "name"), 3)


@query("person_colors", T.sql(W, body="""
, c AS (SELECT text AS name, CAST(word_id % 6 AS INTEGER) AS color, count(*) AS n FROM words GROUP BY ALL)
SELECT name, color FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, color) = 1"""))
def person_colors(spark, sf_dir):
    return M.person_colors(T.words(spark, sf_dir).select(F.col("text").alias("name"), (F.col("word_id") % 6).cast("int").alias("color")))


@query("dedupe_names", """
WITH n AS (SELECT c_nationkey, c_custkey AS ordinal, trim(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE ' ' || lower(c_mktsegment) END) AS name FROM customer)
SELECT * FROM n WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY c_nationkey, lower(name) ORDER BY ordinal) = 1""")
def dedupe_names(spark, sf_dir):
    s = F.col("c_mktsegment")
    rows = T.table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 2 == 0, F.upper(s)).otherwise(F.concat(F.lit(" "), F.lower(s))).alias("name"))
    return M.dedupe_names(rows, ("c_nationkey",))


@query("merge_duplicate_people", """
WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS name, count(*) AS n FROM part GROUP BY ALL)
SELECT lower(name) AS key, arg_min(name, (-n, name)) AS merged, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_spellings FROM n GROUP BY ALL""")
def merge_duplicate_people(spark, sf_dir):
    return M.merge_people(T.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("name")))


@query("name_suggestions", """
WITH n AS (SELECT DISTINCT c_name AS name FROM customer)
SELECT name, CASE WHEN lower(name) = 'customer#000000012' THEN 0 WHEN starts_with(lower(name), 'customer#000000012') THEN 1 ELSE 2 END AS match FROM n WHERE contains(lower(name), 'customer#000000012') ORDER BY 2, 1 LIMIT 8""")
def name_suggestions(spark, sf_dir):
    return M.suggestions(T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct(), "customer#000000012")


@query("timeline_split", T.sql(W, body="SELECT word_id, CASE WHEN start_ms < 900000 THEN 0 ELSE 1 END AS part, CASE WHEN start_ms < 900000 THEN start_ms ELSE start_ms - 900000 END AS start_ms FROM words"))
def timeline_split(spark, sf_dir):
    """U4, U5, U8."""
    return M.split_rows(T.words(spark, sf_dir), 900000).select("word_id", "part", "start_ms")


@query("range_split", T.sql(T.KEPT_SQL, body="""
SELECT range_id, 0 AS part, start_ms, least(end_ms, 900000) AS end_ms FROM kept WHERE least(end_ms, 900000) > start_ms
UNION ALL SELECT range_id, 1, greatest(start_ms - 900000, 0), end_ms - 900000 FROM kept WHERE end_ms - 900000 > greatest(start_ms - 900000, 0)"""))
def range_split(spark, sf_dir):
    """U6, U7."""
    return M.split_ranges(T.kept_ranges(spark, sf_dir), 900000).select("range_id", "part", "start_ms", "end_ms")


@query("timeline_concat", T.sql(W, body="""
, len AS (SELECT session_id, max(end_ms) AS l FROM words GROUP BY ALL), off AS (SELECT session_id, CAST(coalesce(sum(l + 1000) OVER (ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM len)
SELECT w.session_id, word_id, start_ms + o AS start_ms, end_ms + o AS end_ms FROM words w JOIN off USING (session_id)"""))
def timeline_concat(spark, sf_dir):
    """Sessions one after another."""
    from timeweave.operators.sequences import cumulative_offsets

    words = T.words(spark, sf_dir)
    lengths = words.groupBy("session_id").agg(F.max("end_ms").alias("length_ms")).withColumn("one", F.lit(0))
    offsets = cumulative_offsets(lengths, ("one",), ("session_id",)).select("session_id", "offset_ms")
    return M.join_rows(words, offsets, ("session_id",)).select("session_id", "word_id", "start_ms", "end_ms")


@query("split_ancestry", """
WITH RECURSIVE l AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey >= 3), up(child, ancestor, hops) AS (SELECT child, parent, 1 FROM l UNION ALL SELECT up.child, l.parent, up.hops + 1 FROM up JOIN l ON l.child = up.ancestor WHERE up.hops < 16) SELECT * FROM up""")
def split_ancestry(spark, sf_dir):
    return M.ancestors(T.table(spark, sf_dir, "customer").where("c_custkey >= 3").selectExpr("c_custkey AS child", "c_custkey DIV 3 AS parent"))


@query("session_status", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'recording' WHEN o_orderkey % 7 = 0 THEN 'archived' WHEN o_orderstatus = 'O' THEN 'recorded' WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'processed' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'still recording' WHEN o_orderstatus <> 'O' THEN 'already processed' WHEN o_totalprice < 50000 THEN 'too short' END AS refusal FROM orders""")
def session_status(spark, sf_dir):
    """P10, P18."""
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").withColumn("recording", k % 5 == 0).withColumn("archived", k % 7 == 0).withColumn("transcribed", F.col("o_orderstatus") != "O").withColumn("done", k % 2 == 0)
    reasons = [(F.col("recording"), "still recording"), (F.col("transcribed"), "already processed"), (F.col("o_totalprice") < 50000, "too short")]
    return M.refusal(M.session_status(rows), reasons).select("o_orderkey", "status", "refusal")


@query("speaker_ids", """
WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'spk_' || s_suppkey WHEN 1 THEN 'mic_' || s_suppkey WHEN 2 THEN 'SPEAKER_' || s_suppkey ELSE 'spk_x' END AS id FROM supplier)
SELECT s_suppkey, id, CASE s_suppkey % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'mic' END AS source, CASE WHEN s_suppkey % 4 < 2 THEN CAST(s_suppkey AS INTEGER) END AS cluster, starts_with(id, 'SPEAKER_') OR id = 'unknown' AS anonymous FROM t""")
def speaker_ids(spark, sf_dir):
    """P16, P19."""
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("spk_"), k)).when(k % 4 == 1, F.concat(F.lit("mic_"), k)).when(k % 4 == 2, F.concat(F.lit("SPEAKER_"), k)).otherwise("spk_x")
    rows = T.table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("id"))
    source, cluster = M.speaker_id(F.col("id"))
    return rows.select("s_suppkey", "id", source.alias("source"), cluster.alias("cluster"), (F.col("id").startswith("SPEAKER_") | (F.col("id") == "unknown")).alias("anonymous"))


@query("transcript_text", T.sql(W, body="""
SELECT word_id, '[' || printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || '] ' || source || CASE WHEN word_id % 17 = 0 THEN ' [echo]' ELSE '' END || ': ' || text AS line FROM words"""))
def transcript_text(spark, sf_dir):
    """S14."""
    return M.transcript_lines(T.words(spark, sf_dir).withColumn("speaker", F.col("source")).withColumn("echo", F.col("word_id") % 17 == 0)).select("word_id", "line")


@query("fold_groups", T.sql(W, body="""
SELECT session_id, word_id // 8 AS group_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY start_ms, word_id) AS text, bool_and(word_id % 3 <> 0) AS locked, bool_and(source = 'mic') AS echo FROM words GROUP BY ALL"""))
def fold_groups(spark, sf_dir):
    """J34."""
    rows = T.words(spark, sf_dir).withColumn("group_id", F.expr("word_id DIV 8")).withColumn("line_id", F.col("word_id")).withColumn("locked", F.col("word_id") % 3 != 0).withColumn("echo", F.col("source") == "mic")
    return M.fold_groups(rows, ("session_id",))


@query("learn_samples", f"""WITH {T.SAMPLES_SQL}, new AS (SELECT sample_no + 1000 AS sample_no, v FROM samples WHERE sample_no % 5 = 0 UNION ALL SELECT sample_no + 2000, list_transform(v, lambda x: -x) FROM samples WHERE sample_no % 10 < 2 UNION ALL SELECT sample_no + 3000, list_transform(v, lambda x: -x) FROM samples WHERE sample_no % 10 = 1)
SELECT n.sample_no FROM new n WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE list_inner_product(s.v, n.v) >= 0.999) AND NOT EXISTS (SELECT 1 FROM new o WHERE o.sample_no < n.sample_no AND list_inner_product(o.v, n.v) >= 0.999)""")
def learn_samples(spark, sf_dir):
    """J10, J11, D2."""
    rows = T.samples(spark, sf_dir)
    minus = F.transform("v", lambda x: -x).alias("v")
    new = rows.where("sample_no % 5 = 0").select((F.col("sample_no") + 1000).alias("sample_no"), "v").unionByName(rows.where("sample_no % 10 < 2").select((F.col("sample_no") + 2000).alias("sample_no"), minus)).unionByName(rows.where("sample_no % 10 = 1").select((F.col("sample_no") + 3000).alias("sample_no"), minus))
    return M.upsert_learned(rows.select("sample_no", "v"), new).select("sample_no")


@query("span_filter", T.sql(W, body="SELECT word_id, start_ms >= 100000 AND start_ms < 1500000 AS in_span, greatest(0, least(end_ms, 1500000) - greatest(start_ms, 100000)) AS clipped_ms, greatest(start_ms - 2000, 0) AS clip_start, least(end_ms + 2000, 2600000) AS clip_end FROM words"))
def span_filter(spark, sf_dir):
    """P1, P2, P26."""
    return T.words(spark, sf_dir).select("word_id", ((F.col("start_ms") >= 100000) & (F.col("start_ms") < 1500000)).alias("in_span"), F.greatest(F.lit(0), F.least("end_ms", F.lit(1500000)) - F.greatest("start_ms", F.lit(100000))).alias("clipped_ms"), F.greatest(F.col("start_ms") - 2000, F.lit(0)).alias("clip_start"), F.least(F.col("end_ms") + 2000, F.lit(2600000)).alias("clip_end"))


@query("annotations", T.sql(U, body="SELECT session_id, turn, regexp_matches(trim(m), '^(\\[.*\\]|\\(.*\\)|[♪♫ ]*)$') AS annotation FROM (SELECT session_id, turn, CASE turn % 4 WHEN 0 THEN '[' || role_ || ']' WHEN 1 THEN '♪ ♪' WHEN 2 THEN ' ' ELSE text END AS m FROM (SELECT *, speaker AS role_ FROM utt))"))
def annotations(spark, sf_dir):
    """P12."""
    t = F.col("turn") % 4
    m = F.when(t == 0, F.concat(F.lit("["), "speaker", F.lit("]"))).when(t == 1, "♪ ♪").when(t == 2, " ").otherwise(F.col("text"))
    return T.utterances(spark, sf_dir).select("session_id", "turn", F.trim(m).rlike(r"^(\[.*\]|\(.*\)|[♪♫ ]*)$").alias("annotation"))
