"""Sequence operators: sessionization, islands, windows, offsets and rows of a timeline."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session_id", "source")
CLOSING = ".,?!:;%)]}"


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], new: Column, name: str = "island") -> DataFrame:
    """``rows`` numbered by runs; a run starts where ``new`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def clean_text(text: Column) -> Column:
    """Unicode white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def join_words(words: Column) -> Column:
    """words in order with blanks, none before closing punctuation."""
    return F.regexp_replace(F.array_join(words, " "), r" (?=[.,?!:;%)\]}])", "")


def ends_sentence(text: Column) -> Column:
    """F3."""
    return text.rlike(r"[.?!]\s*$")


def utterances_by_gap(words: DataFrame, attributes: Sequence[str] = (), gap_ms: int = 1000) -> DataFrame:
    """W2 without the length rule: a row ends where an attribute changes or more than ``gap_ms`` passes since its latest end."""
    w = Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms", "word_id")
    changed = F.lit(False)
    for a in attributes:
        changed = changed | ~F.lag(a).over(w).eqNullSafe(F.col(a))
    marked = words.withColumn("_changed", changed | F.lag("start_ms").over(w).isNull())
    blocks = marked.withColumn("_block", F.sum(F.col("_changed").cast("int")).over(w))
    inner = Window.partitionBy(*KEYS, "_block").orderBy("start_ms", "end_ms", "word_id")
    # Within a block the latest end of all words before is that of the open row, or lies further back than the gap.
    reach = F.max("end_ms").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    runs = blocks.withColumn("_new", F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(inner))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "word_id", "text"))), lambda s: s["text"])
    return runs.groupBy(*KEYS, *attributes, "_block", "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words"), join_words(texts).alias("text")).drop("_block", "_run")


def utterances(words: DataFrame, gap_ms: int = 1000, long_ms: int = 15_000) -> DataFrame:
    """W2 in full: words with speaker_id, speaker, locked, kept, echo and turn become lines.

    A line ends where kept, echo or turn change, and outside turns also where id,
    name or lock change, the gap is exceeded, or a line of ``long_ms`` ends a
    sentence. The last rule depends on the open line, so words are folded in
    order. The attribute and gap breaks, which don't, cut the words into blocks
    first; blocks stream through a task in order, one open line at a time.
    """
    w = Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms", "word_id")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    outside = F.col("turn").isNull()
    differs = lambda *cols: F.concat_ws("|", *[(~F.lag(c).over(w).eqNullSafe(F.col(c))).cast("string") for c in cols]).contains("true")
    hard = reach.isNull() | differs("kept", "echo", "turn") | (outside & (differs("speaker_id", "speaker", "locked") | (F.col("start_ms") - reach > gap_ms)))
    blocks = words.withColumn("_hard", hard).withColumn("_block", F.sum(F.col("_hard").cast("int")).over(w)).drop("_hard")
    columns = "session_id long, source string, start_ms long, end_ms long, speaker_id string, speaker string, locked boolean, kept boolean, echo boolean, turn string, n_words long, text string"
    names = [c.split()[0] for c in columns.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, block = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.itertuples(index=False):
                text = " ".join(str(row.text).split())
                own = (row.session_id, row.source, row.block)
                ended = open_ is None or own != block or pd.isna(row.turn) and (row.start_ms - open_["end_ms"] > gap_ms or (open_["end_ms"] - open_["start_ms"] >= long_ms and open_["text"].rstrip().endswith((".", "?", "!"))))
                if not ended:
                    open_["end_ms"] = max(open_["end_ms"], row.end_ms)
                    open_["n_words"] += 1
                    open_["text"] += text if not open_["text"] or text[:1] in CLOSING else f" {text}"
                else:
                    if open_ is not None:
                        out.append(open_)
                    open_, block = {c: getattr(row, c) for c in names if c not in ("n_words", "text")} | {"n_words": 1, "text": text}, own
            yield pd.DataFrame([o for o in out if o["text"]], columns=names)
        yield pd.DataFrame([open_] if open_ and open_["text"] else [], columns=names)

    sorted_ = blocks.withColumnRenamed("_block", "block").repartition(*KEYS, "block").sortWithinPartitions(*KEYS, "block", "start_ms", "end_ms", "word_id")
    return sorted_.mapInPandas(fold, columns)


def phrases(words: DataFrame, gap_ms: int = 900, span_ms: int = 12_000) -> DataFrame:
    """Runs of words that break after a gap, or where the run would be longer than ``span_ms``.

    Gap breaks need no state and cut the words into blocks; the span, which starts
    anew with each run, is folded within a block.
    """
    w = Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms", "word_id")
    cut = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms, F.lit(True))
    blocks = words.withColumn("_cut", cut).withColumn("_block", F.sum(F.col("_cut").cast("int")).over(w))
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "word_id")))
    folded = F.aggregate(
        listed, F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,n:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["end_ms"] - F.element_at(acc, -1)["start_ms"] <= span_ms), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start_ms"].alias("start_ms"), F.greatest(F.element_at(acc, -1)["end_ms"], x["end_ms"]).alias("end_ms"), (F.element_at(acc, -1)["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.lit(1).cast("bigint").alias("n"))))),
    )
    return blocks.groupBy(*KEYS, "_block").agg(folded.alias("_p")).select(*KEYS, F.explode("_p").alias("_p")).select(*KEYS, "_p.*")


def speech_regions(frames: DataFrame, speech: Column, keys: Sequence[str] = KEYS, hangover: int = 10, least: int = 13, merge: int = 25, pad: int = 15) -> DataFrame:
    """Speech frames to regions: bridge short pauses, drop short bursts, merge close ones, pad, merge overlaps."""
    w = Window.partitionBy(*keys).orderBy("frame")
    active = frames.where(speech)
    runs = islands(active.withColumn("_b", F.lag("frame").over(w)), keys, ["frame"], F.col("_b").isNull() | (F.col("frame") - F.col("_b") > hangover + 1), "_run")
    raw = runs.groupBy(*keys, "_run").agg(F.min("frame").alias("a"), (F.max("frame") + 1).alias("b")).where(F.col("b") - F.col("a") >= least)
    v = Window.partitionBy(*keys).orderBy("a")
    joined = islands(raw.withColumn("_e", F.lag("b").over(v)), keys, ["a"], F.col("_e").isNull() | (F.col("a") - F.col("_e") > merge), "_m").groupBy(*keys, "_m").agg(F.greatest(F.min("a") - pad, F.lit(0)).alias("a"), (F.max("b") + pad).alias("b"))
    last = islands(joined.withColumn("_e", F.lag("b").over(v)), keys, ["a"], F.col("_e").isNull() | (F.col("a") > F.col("_e")), "_p")
    return last.groupBy(*keys, "_p").agg(F.min("a").alias("start_frame"), F.max("b").alias("end_frame")).drop("_p")


def smooth_marks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], mark: str, explained: str) -> DataFrame:
    """What lies unmarked but explained between two marked rows is marked; only marks from before count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    between = F.coalesce(F.lag(mark).over(w), F.lit(False)) & F.coalesce(F.lead(mark).over(w), F.lit(False)) & F.col(explained)
    return rows.withColumn("smoothed", F.col(mark) | between)


def mark_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], mark: str) -> DataFrame:
    """Spans, counts and mean value of consecutive marked rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(rows.withColumn("_b", F.lag(mark).over(w)), keys, order, ~F.col(mark).eqNullSafe(F.col("_b")), "_run").where(mark)
    return runs.groupBy(*keys, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("_run")


def frame_runs(frames: DataFrame, led: Column, keys: Sequence[str], gap: int = 10, least: int = 40, widen_ms: int = 250, frame_ms: int = 10) -> DataFrame:
    """Stretches of led frames with short gaps and enough frames, widened."""
    w = Window.partitionBy(*keys).orderBy("frame")
    runs = islands(frames.where(led).withColumn("_b", F.lag("frame").over(w)), keys, ["frame"], F.col("_b").isNull() | (F.col("frame") - F.col("_b") > gap), "_run")
    found = runs.groupBy(*keys, "_run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.select(*keys, F.greatest(F.col("a") * frame_ms - widen_ms, F.lit(0)).alias("start_ms"), ((F.col("b") + 1) * frame_ms + widen_ms).alias("end_ms"), "n")


def sub_windows(segments: DataFrame, most_ms: int = 10_000) -> DataFrame:
    """ceil(length / most) equal integer windows of each segment."""
    length = F.expr("end_ms - start_ms")
    parts = segments.where(length > 0).withColumn("_n", F.expr(f"(end_ms - start_ms + {most_ms - 1}) DIV {most_ms}")).withColumn("part", F.explode(F.expr("sequence(0L, _n - 1)")))
    return parts.withColumn("win_start", F.expr("start_ms + (end_ms - start_ms) * part DIV _n")).withColumn("win_end", F.expr("start_ms + (end_ms - start_ms) * (part + 1) DIV _n")).drop("_n")


def sliding_counts(rows: DataFrame, at: str, window_ms: int, step_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows in overlapping windows that start at every step."""
    first = F.expr(f"greatest(0L, ({at} - {window_ms}) DIV {step_ms} + IF({at} >= {window_ms}, 1, 0))")
    spread = rows.withColumn("win", F.explode(F.sequence(first, F.expr(f"{at} DIV {step_ms}"))))
    return spread.groupBy(*keys, (F.col("win") * step_ms).alias("win_start")).agg(F.count(F.lit(1)).alias("n"))


def frame_votes(votes: DataFrame, keep: int, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """In each frame the ``keep`` clusters with most votes, the lower cluster of equals."""
    counted = votes.groupBy(*keys, "frame", "cluster").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy(*keys, "frame").orderBy(F.col("votes").desc(), "cluster"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= keep)


def monotone(words: DataFrame) -> DataFrame:
    """Starts not before the latest end so far, ends not before starts."""
    w = Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms", "word_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("start_ms"), F.coalesce(F.max("end_ms").over(w), F.lit(0)))
    return words.withColumn("new_start", start).withColumn("new_end", F.greatest("end_ms", "new_start"))


def renumber(rows: DataFrame, keys: Sequence[str], label: str, position: str) -> DataFrame:
    """Labels 0, 1, .. by first appearance."""
    first = rows.groupBy(*keys, label).agg(F.min(position).alias("first_at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("first_at", label)) - 1)


def evenly_spaced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, evenly spread: those where rank * limit / n reaches a new integer."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    chosen = (F.col("_n") <= limit) | (F.col("_r") == F.expr(f"((_r * {limit} + _n - 1) DIV _n) * _n DIV {limit}")) & (F.expr(f"(_r * {limit} + _n - 1) DIV _n") < limit)
    return ranked.where(chosen).drop("_r", "_n")


def cumulative_offsets(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], seam_ms: int = 1000) -> DataFrame:
    """Starts of pieces that follow each other with a seam between."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset_ms", F.coalesce(F.sum(F.col("length_ms") + seam_ms).over(w), F.lit(0)))


def seams(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From where a piece ends to where the next begins."""
    w = Window.partitionBy(*keys).orderBy("offset_ms")
    after = pieces.withColumn("next_ms", F.lead("offset_ms").over(w)).where("next_ms IS NOT NULL")
    return after.select(*keys, (F.col("offset_ms") + F.col("length_ms")).alias("start_ms"), F.col("next_ms").alias("end_ms"))


def wallclock_at(points: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The piece with the last offset by the point, and time elapsed in it, its length at most."""
    both = points.select(*keys, F.col("at_ms"), F.col("point_id"), F.lit(None).cast("long").alias("offset_ms"), F.lit(None).cast("long").alias("length_ms")).unionByName(pieces.select(*keys, F.col("offset_ms").alias("at_ms"), F.lit(None).cast("long").alias("point_id"), "offset_ms", "length_ms"))
    w = Window.partitionBy(*keys).orderBy("at_ms", F.col("point_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("piece_ms", F.last("offset_ms", True).over(w)).withColumn("_l", F.last("length_ms", True).over(w))
    return filled.where("point_id IS NOT NULL AND piece_ms IS NOT NULL").select(*keys, "point_id", "at_ms", "piece_ms", F.least(F.col("at_ms") - F.col("piece_ms"), "_l").alias("elapsed_ms"))


def quiet_threshold(levels: Column) -> Column:
    """Four times the element n / 10 of the sorted levels, within [0.003, 0.03]."""
    s = F.sort_array(levels)
    return F.least(F.greatest(F.get(s, (F.size(s) / 10).cast("int")) * 4, F.lit(0.003)), F.lit(0.03))


def quiet_stretches(levels: DataFrame, keys: Sequence[str] = ("session_id",), bucket_ms: int = 50, least_ms: int = 600) -> DataFrame:
    """Stretches in which every track is quiet; a track without a bucket there is quiet."""
    limits = levels.groupBy(*keys, "source").agg(quiet_threshold(F.collect_list("rms")).alias("limit"))
    loud = levels.join(limits, [*keys, "source"]).where(F.col("rms") > F.col("limit")).select(*keys, "bucket").distinct()
    span = levels.groupBy(*keys).agg((F.max("bucket") + 1).alias("_n"))
    edges = loud.unionByName(span.select(*keys, F.col("_n").alias("bucket"))).unionByName(span.select(*keys, F.lit(-1).cast("long").alias("bucket")))
    w = Window.partitionBy(*keys).orderBy("bucket")
    gaps = edges.withColumn("_b", F.lag("bucket").over(w)).where(F.col("bucket") - F.col("_b") > 1)
    return gaps.select(*keys, ((F.col("_b") + 1) * bucket_ms).alias("start_ms"), (F.col("bucket") * bucket_ms).alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def snap_to_quiet(points: DataFrame, stretches: DataFrame, keys: Sequence[str] = ("session_id",), margin_ms: int = 1000) -> DataFrame:
    """The nearest place inside a stretch, a margin of at most half its length away from its ends; the earlier stretch of equals.

    The nearest candidates lie in the last stretch that starts by the point or in
    the next one, so both are found by one ordered pass.
    """
    s = stretches.withColumn("_m", F.least(F.expr("(end_ms - start_ms) DIV 2"), F.lit(margin_ms))).select(*keys, (F.col("start_ms") + F.col("_m")).alias("lo"), (F.col("end_ms") - F.col("_m")).alias("hi"))
    none = F.lit(None).cast("struct<lo:bigint,hi:bigint>")
    both = points.select(*keys, "at_ms", "point_id", none.alias("s")).unionByName(s.select(*keys, F.col("lo").alias("at_ms"), F.lit(None).cast("long").alias("point_id"), F.struct("lo", "hi").alias("s")))
    w = Window.partitionBy(*keys).orderBy("at_ms", F.col("point_id").isNotNull())
    near = both.withColumn("_a", F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("point_id IS NOT NULL")
    snap = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col("at_ms"), F.col(f"{c}.lo")), F.col(f"{c}.hi")))
    rated = near.withColumn("_x", snap("_a")).withColumn("_y", snap("_b"))
    closer = F.col("_x").isNull() | (F.abs(F.col("_y") - F.col("at_ms")) < F.abs(F.col("_x") - F.col("at_ms")))
    return rated.select(*keys, "point_id", "at_ms", F.when(F.col("_y").isNotNull() & closer, F.col("_y")).otherwise(F.col("_x")).alias("snapped_ms"))


def row_ends(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row ends at its own end or the next start, at least a millisecond after its start."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "row_id")
    return rows.withColumn("row_end", F.greatest(F.least("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("end_ms"))), F.col("start_ms") + 1))


def fold_bounds(rows: DataFrame, keys: Sequence[str], start_ms: int, end_ms: int) -> DataFrame:
    """How many leading rows end by ``start_ms`` and trailing rows start from ``end_ms``."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "row_id")
    before = F.min((F.col("start_ms") < start_ms).cast("int")).over(w)
    after = F.min((F.col("start_ms") >= end_ms).cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("_b", before).withColumn("_a", after).groupBy(*keys).agg(F.sum("_b").alias("leading"), F.sum("_a").alias("trailing"), F.count(F.lit(1)).alias("n"))


def timeline_rows(lines: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """A line joins the last row if it and a line of the other side there share half of the shorter; a line lasts a millisecond at least.

    Which row is open depends on the lines before, so each session's lines are
    folded in order, in batches.
    """
    schema = "session_id long, row int, line_id long, source string, start_ms long, end_ms long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, row, members = None, -1, []
        for batch in batches:
            out = []
            for own, line, source, start, end in zip(*(batch[c] for c in ("session_id", "line_id", "source", "start_ms", "end_ms"))):
                if own != session:
                    session, row, members = own, -1, []
                last = max(end, start + 1)
                shared = [(min(last, b) - max(start, a), min(last - start, b - a)) for side, a, b in members if side != source]
                if not any(0 < overlap and shorter <= 2 * overlap for overlap, shorter in shared):
                    row, members = row + 1, []
                members.append((source, start, last))
                out.append((own, row, line, source, start, end))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    ordered = lines.select("session_id", "line_id", "source", "start_ms", "end_ms").repartition(*keys).sortWithinPartitions(*keys, "start_ms", "line_id")
    return ordered.mapInPandas(fold, schema)


def token_turns(tokens: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each token the latest cut at or before its start, null before the first; an as-of join by one ordered pass."""
    none = F.lit(None).cast("long")
    both = tokens.select(*keys, "start_ms", "token", none.alias("_cut")).unionByName(cuts.select(*keys, F.col("cut_ms").alias("start_ms"), none.alias("token"), F.col("cut_ms").alias("_cut")))
    w = Window.partitionBy(*keys).orderBy("start_ms", F.col("_cut").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("cut_ms", F.max("_cut").over(w)).where("token IS NOT NULL").select(*keys, "token", "start_ms", "cut_ms")


def token_groups(words: DataFrame) -> DataFrame:
    """Words that are punctuation, or start with the word before, join its token."""
    w = Window.partitionBy(*KEYS).orderBy("start_ms", "end_ms", "word_id")
    joined = F.col("text").rlike(r"^[^\p{L}\p{N}]+$") | (F.lag("start_ms").over(w) == F.col("start_ms"))
    marked = words.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)) & F.lag("start_ms").over(w).isNotNull(), 0).otherwise(1)).withColumn("token", F.sum("_new").over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "word_id", "text"))), lambda s: s["text"])
    return marked.groupBy(*KEYS, "token").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), join_words(texts).alias("text"))
