"""Queries without a relational form, and replays of streams and files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.functions import scalars as X
from timeweave.operators import alignment as A
from timeweave.operators import sequences as Q
from timeweave.operators import signals as G
from timeweave.plans.catalogue import query
from timeweave.session import own_folder
from timeweave.sources import files
from timeweave.sources import tables as T
from timeweave.streaming import capture


def _scratch(spark: SparkSession, label: str) -> str:
    """A new folder where the cluster's nodes can all read it; it goes when the application ends."""
    return own_folder(spark, label)


@query("token_alignment")
def token_alignment(spark, sf_dir):
    """each turn's tokens beside those of the turn before."""
    rows = T.utterances(spark, sf_dir).select("session_id", "turn", F.filter(F.transform(F.split("text", " "), X.normalize_token), lambda x: x.isNotNull()).alias("w"))
    after = rows.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b"))
    pairs = rows.join(after, ["session_id", "turn"]).select(F.concat_ws(":", "session_id", "turn").alias("pair_id"), F.col("w").alias("a"), "b")
    return A.aligned(pairs).withColumn("similarity", F.round("similarity", 6))


@query("text_echo")
def text_echo(spark, sf_dir):
    """Phrases of the microphone against the system's words."""
    words = T.words(spark, sf_dir)
    phrase = words.where("source = 'mic'").withColumn("phrase_id", F.expr("concat(session_id, ':', start_ms DIV 12000)"))
    phrases = phrase.groupBy("session_id", "phrase_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("start_ms", F.col("text").alias("t")))).alias("tokens"))
    return A.text_echo(phrases, words.where("source = 'system'").select("session_id", "start_ms", "end_ms", F.col("text").alias("token")), similarity=0.5)


#: The first four samples are the centres; in windows of three rows every placing of the rows is tried.
_ASSIGN_SQL = f"""WITH {T.SAMPLES_SQL},
c AS (SELECT CAST(sample_no AS INTEGER) AS c, v FROM samples WHERE sample_no < 4),
x AS (SELECT sample_no // 3 AS win, sample_no % 3 AS row, c, list_inner_product(s.v, c.v) AS d FROM samples s, c),
o AS (SELECT win, c, max(d) FILTER (row = 0) AS d0, max(d) FILTER (row = 1) AS d1, max(d) FILTER (row = 2) AS d2 FROM x GROUP BY ALL),
p AS (SELECT a.win, a.c AS c0, CASE WHEN b.d1 IS NOT NULL THEN b.c END AS c1, CASE WHEN e.d2 IS NOT NULL THEN e.c END AS c2, a.d0 + coalesce(b.d1, 0) + coalesce(e.d2, 0) AS total
      FROM o a JOIN o b ON b.win = a.win AND (b.c <> a.c OR b.d1 IS NULL) JOIN o e ON e.win = a.win AND (e.d2 IS NULL OR (e.c <> a.c AND e.c <> b.c))),
best AS (SELECT win, arg_max([c0, c1, c2], total) AS cs FROM p GROUP BY win)
SELECT win, CAST(k AS BIGINT) AS row, cs[CAST(k + 1 AS INTEGER)] AS cluster FROM best, range(3) t(k) WHERE cs[CAST(k + 1 AS INTEGER)] IS NOT NULL"""


@query("assign_window", _ASSIGN_SQL)
def assign_window(spark, sf_dir):
    """J35, J36 over windows of three samples; four centres are the model's."""
    rows = T.samples(spark, sf_dir)
    centres = np.array([r["v"] for r in rows.where("sample_no < 4").orderBy("sample_no").collect()])
    items = rows.select(F.expr("sample_no DIV 3").alias("win"), (F.col("sample_no") % 3).alias("row"), "v")
    return A.assigned_windows(items, centres)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as capture blocks of 2,048 samples in the order of their clocks, with every 50th event's block lost; recordings start at 0."""
    order = F.row_number().over(Window.partitionBy("session_id", "source").orderBy("p", "event_id")).cast("long")
    rows = T.events(spark, sf_dir).withColumn("seq", order).where("event_id % 50 <> 7")
    return rows.select("session_id", "source", "seq", (F.col("p") * 1_000_000).alias("capture_ns"), F.lit(2048).cast("long").alias("samples"), F.lit(0).cast("long").alias("started_ns"))


_PLACED_SQL = T.sql(body="""
, b AS (SELECT session_id, source, event_id, row_number() OVER (PARTITION BY session_id, source ORDER BY p, event_id) AS seq, p * 16 AS due FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, source ORDER BY seq) AS k FROM b WHERE event_id % 50 <> 7),
f AS (SELECT session_id, source, k, seq, 0::BIGINT AS place, least(due, 960000) AS silence, due AS gap, false AS filled, least(due, 960000) + 2048 AS written, false AS pending, 0::BIGINT AS lost FROM k WHERE k = 1
  UNION ALL
  SELECT session_id, source, k, seq, place, CASE WHEN filled THEN least(gap, 960000) ELSE 0 END, gap, filled, place + CASE WHEN filled THEN least(gap, 960000) ELSE 0 END + 2048, gap > 480 AND NOT filled, lost
  FROM (SELECT k.session_id, k.source, k.k, k.seq, f.written AS place, k.due - f.written AS gap, k.due - f.written > 480 AND f.pending AS filled, k.seq - f.seq - 1 AS lost FROM f JOIN k ON k.session_id = f.session_id AND k.source = f.source AND k.k = f.k + 1))
SELECT session_id, source, seq, silence AS at_sample, 2048 AS samples, silence, 'start' AS event, gap AS amount FROM f WHERE k = 1
UNION ALL SELECT session_id, source, seq, place, 0, 0, 'dropped', lost FROM f WHERE k > 1 AND lost > 0
UNION ALL SELECT session_id, source, seq, place, 0, silence, 'gap', silence FROM f WHERE filled
UNION ALL SELECT session_id, source, seq, place, 0, 0, 'overlap', -gap FROM f WHERE k > 1 AND -gap > 4000
UNION ALL SELECT session_id, source, seq, place + silence, 2048, silence, 'block', 0 FROM f WHERE k > 1""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("stream_gap_fill", _PLACED_SQL)
def stream_gap_fill(spark, sf_dir):
    """Blocks replayed as a stream with state by track, written and read back."""
    path = _scratch(spark, "capture")
    blocks = _blocks(spark, sf_dir)
    blocks.write.parquet(f"{path}/in")
    replay = spark.readStream.schema(blocks.schema).parquet(f"{path}/in")
    stream = capture.placed_blocks(replay).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(capture.PLACED).parquet(f"{path}/out")


@query("batch_gap_fill", _PLACED_SQL)
def batch_gap_fill(spark, sf_dir):
    """T2-T4 over the finished recordings; equal to the stream's rows."""
    return capture.placed_batch(_blocks(spark, sf_dir))


@query("stream_levels", T.sql(body="SELECT source, max(value) AS peak, max(event_id) AS seq FROM ev GROUP BY ALL"))
def stream_levels(spark, sf_dir):
    """T5: levels replayed as a stream; each micro-batch's changed rows replace those before."""
    path = _scratch(spark, "levels")
    levels = T.events(spark, sf_dir).select("source", F.col("value").alias("peak"), F.col("event_id").alias("seq"))
    levels.write.parquet(f"{path}/in")
    replay = spark.readStream.schema(levels.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/out")

    capture.live_levels(replay).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("source string, peak double, seq long, batch long").parquet(f"{path}/out")
    return told.groupBy("source").agg(F.max_by("peak", "batch").alias("peak"), F.max_by("seq", "batch").alias("seq"))


@query("watched_files", T.sql(body="SELECT source, count(*) AS files FROM (SELECT DISTINCT session_id, source FROM ev) GROUP BY ALL"))
def watched_files(spark, sf_dir):
    """Folders of text files watched as a stream, a few files a micro-batch."""
    path = _scratch(spark, "watched")
    T.events(spark, sf_dir).select("source", "session_id").distinct().select(F.concat_ws("-", F.lit("s"), "session_id").alias("value"), "source", "session_id").write.partitionBy("source", "session_id").text(f"{path}/in")
    watched = capture.watch_files(spark, f"{path}/in/*/*", "*.txt", files_per_batch=7)
    watched.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema("path string, time timestamp, size long").parquet(f"{path}/out")
    return seen.groupBy(F.regexp_extract("path", "source=([a-z]+)/", 1).alias("source")).agg(F.count(F.lit(1)).alias("files"))


@query("jsonl_round_trip", T.sql(T.WORDS_SQL, body="SELECT source, start_ms, end_ms, text FROM words"))
def jsonl_round_trip(spark, sf_dir):
    """Words written as JSON lines and read with their schema."""
    path = _scratch(spark, "words")
    files.write_lines(T.words(spark, sf_dir).select("source", "start_ms", "end_ms", "text"), path)
    return files.read_lines(spark, path, files.SCHEMAS["words"])


@query("appended_lines", T.sql(T.WORDS_SQL, body="SELECT source, start_ms, end_ms, text FROM words"))
def appended_lines(spark, sf_dir):
    """Words that arrive as a stream, appended as JSON lines, exactly once."""
    path = _scratch(spark, "appended")
    words = T.words(spark, sf_dir).select("source", "start_ms", "end_ms", "text")
    words.repartition(4, "start_ms").write.parquet(f"{path}/in")
    arriving = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    files.append_lines(arriving, f"{path}/out", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return files.read_lines(spark, f"{path}/out", files.SCHEMAS["words"])


@query("correctable_lines", T.sql(T.WORDS_SQL, body="SELECT source, start_ms, text, word_id % 10 = 0 AS locked FROM words"))
def correctable_lines(spark, sf_dir):
    """S3: lines of the transcript, outside the meeting and hidden, written apart and read as one."""
    path = _scratch(spark, "lines")
    rows = T.words(spark, sf_dir).withColumn("locked", F.col("word_id") % 10 == 0)
    for name, part in (("transcript", "word_id % 3 = 0"), ("outside-meeting", "word_id % 3 = 1"), ("hidden-lines", "word_id % 3 = 2")):
        files.write_lines(rows.where(part).select("source", "start_ms", "end_ms", "text", "locked"), f"{path}/{name}.jsonl")
    return files.read_correctable(spark, path).select("source", "start_ms", "text", "locked")


@query("wav_round_trip", "SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS pos, CAST(least(greatest(floor(CAST(unnest(embedding) AS DOUBLE) * 32768 + 0.5), -32768), 32767) AS INTEGER) AS sample FROM embeddings")
def wav_round_trip(spark, sf_dir):
    """Vectors as tracks, written as 16-bit WAV files and read back."""
    tracks = T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    return files.wav_samples(files.write_wav(tracks, ["vec_id"]), ["vec_id"])


@query("control_messages", T.sql(body="SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN event_type END AS event, CASE WHEN event_id % 3 <> 2 THEN event_id % 10 / 10.0 END::DOUBLE AS fraction FROM ev"))
def control_messages(spark, sf_dir):
    """Tagged messages; lines that are none have no tag."""
    k = F.col("event_id")
    text = F.when(k % 3 != 2, F.to_json(F.struct(F.col("event_type").alias("event"), (k % 10 / 10.0).alias("fraction"), k.cast("string").alias("message")))).otherwise(F.concat(F.lit("stop please "), k))
    parsed = capture.control_messages(T.events(spark, sf_dir).select(text.alias("value")))
    return parsed.select(F.coalesce("message", F.element_at(F.split("value", " "), -1)).cast("long").alias("event_id"), "event", "fraction")


@query("progress_metrics", T.sql(body="SELECT event_id, least(greatest(p / nullif(event_id % 7 * 500000, 0), 0), 1) AS fraction, p / nullif(greatest(p * 2 - event_id, 0), 0) AS speed FROM ev"))
def progress_metrics(spark, sf_dir):
    """A30, T12."""
    k = F.col("event_id")
    rows = T.events(spark, sf_dir).select("event_id", F.col("p").alias("done_ms"), (k % 7 * 500000).alias("total_ms"), (F.col("p") * 2).alias("elapsed_ms"), k.alias("paused_ms"))
    return capture.processing_progress(rows).select("event_id", "fraction", "speed")


@query("rms_envelope", T.sql(body="""
, s AS (SELECT DISTINCT ON (session_id, source, p) session_id, source, p, value FROM ev ORDER BY session_id, source, p, event_id),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, source ORDER BY p) - 1 AS pos FROM s)
SELECT session_id, source, pos // 16 AS frame, round(sqrt(avg(value * value)), 6) AS rms FROM n GROUP BY ALL HAVING count(*) = 16"""))
def rms_envelope(spark, sf_dir):
    """Readings as samples, in frames of 16."""
    rows = T.events(spark, sf_dir).groupBy("session_id", "source", "p").agg(F.min_by("value", "event_id").alias("sample"))
    samples = rows.withColumn("pos", F.row_number().over(Window.partitionBy("session_id", "source").orderBy("p")) - 1)
    return G.rms_frames(samples, ("session_id", "source"), 16).select("session_id", "source", F.col("frame"), F.round("rms", 6).alias("rms"))


@query("joined_levels", T.sql(body="""
, l AS (SELECT session_id, event_id % 3 AS piece, p // 5000 AS bucket, max(value) AS peak FROM ev WHERE source = 'mic' GROUP BY ALL),
g AS (SELECT session_id, piece, piece * 300 AS off, max(bucket) + 1 - piece AS buckets FROM l GROUP BY session_id, piece),
w AS (SELECT session_id, unnest(range(max(off + buckets))) AS bucket FROM g GROUP BY session_id),
x AS (SELECT session_id, off + bucket AS bucket, max(peak) AS peak FROM l JOIN g USING (session_id, piece) WHERE bucket < buckets GROUP BY ALL)
SELECT session_id, bucket, coalesce(peak, 0) AS peak FROM w LEFT JOIN x USING (session_id, bucket)"""))
def joined_levels(spark, sf_dir):
    """Three pieces of a track at their places, silence elsewhere."""
    levels = T.events(spark, sf_dir).where("source = 'mic'").groupBy("session_id", (F.col("event_id") % 3).alias("piece"), F.expr("p DIV 5000").alias("bucket")).agg(F.max("value").alias("peak"))
    pieces = levels.groupBy("session_id", "piece").agg((F.col("piece") * 300).alias("offset"), (F.max("bucket") + 1 - F.col("piece")).alias("buckets"))
    return G.joined_envelope(levels, pieces, ("session_id",))


@query("frame_masks", T.sql(T.FRAMES_SQL, body="""
, m AS (SELECT *, rms > 0.02 AS mask, row_number() OVER (PARTITION BY session_id, source ORDER BY frame) AS i FROM frames),
r AS (SELECT *, i - row_number() OVER (PARTITION BY session_id, source, mask ORDER BY frame) AS run FROM m)
SELECT session_id, source, min(frame) * 10 AS start_ms, max(frame) * 10 + 10 AS end_ms, count(*) AS n FROM r WHERE mask GROUP BY session_id, source, run"""))
def frame_masks(spark, sf_dir):
    """Runs of frames with an active mask."""
    frames = T.frames(spark, sf_dir).withColumn("start_ms", F.col("frame") * 10).withColumn("end_ms", F.col("frame") * 10 + 10).withColumn("mask", F.col("rms") > 0.02)
    return Q.mark_runs(frames, ("session_id", "source"), ["frame"], "mask")
