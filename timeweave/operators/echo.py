"""Echo of the remote side in the microphone's words: three passes, each of which sees what those before it marked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions import scalars as X
from timeweave.operators.alignment import align, timing
from timeweave.operators.intervals import range_join
from timeweave.operators.signals import lag_correlations
from timeweave.session import stored

#: Phrases (ms), candidates around them, what makes words, texts and leads an echo.
PHRASE_GAP_MS, PHRASE_MS, EARLY_MS, LATE_MS = 900, 12_000, 1_500, 500
WORD_EXCESS_LN, WORD_CORRELATION = 0.7, 0.75
TEXT_MATCHES, AUDIO_MATCHES, TEXT_SIMILARITY, AUDIO_SIMILARITY, AUDIO_CORRELATION = 4, 2, 0.85, 0.65, 0.75
MATCHED_MS, TEXT_DELAY_MS, DEVIATION_MS, DELAY_DIFFERENCE_MS = 600, (-250, 750), 350, 500
LEAD_SHARE, VOICE_LEAD_SHARE, LEAD_FRAMES = 0.7, 0.4, 5
FRAME_MS, DELAY_FRAMES = 10, range(-25, 101)
_WORD = "session_id long, word_id long, start_ms long, end_ms long, text string"


def with_phrases(words: DataFrame, gap_ms: int = PHRASE_GAP_MS, span_ms: int = PHRASE_MS) -> DataFrame:
    """Microphone words (session_id, word_id, start_ms, end_ms, text) with the ``phrase`` they are in.

    A phrase ends after a gap, or where it would get too long. Words stream
    through a task in order, with one open phrase.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, phrase, first, last = None, 0, 0, 0
        for batch in batches:
            out = []
            for own, start, end in zip(batch["session_id"], batch["start_ms"], batch["end_ms"]):
                if own != session:
                    session, phrase, first = own, 0, start
                elif start - last > gap_ms or end - first > span_ms:
                    phrase, first = phrase + 1, start
                last = end
                out.append(phrase)
            yield batch.assign(phrase=np.array(out, dtype=np.int64))

    own = words.select(*[c.split()[0] for c in _WORD.split(", ")]).repartition("session_id").sortWithinPartitions("session_id", "start_ms", "end_ms", "word_id")
    return own.mapInPandas(fold, _WORD + ", phrase long")


def in_spans(words: DataFrame, spans: DataFrame) -> DataFrame:
    """(session_id, word_id) of words that overlap a half-open span of their session; a word lasts a millisecond at least."""
    met = range_join(words, spans, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), F.col("end_ms")), keys=("session_id",))
    return met.where("r_start_ms < greatest(end_ms, start_ms + 1) AND start_ms < r_end_ms").select("session_id", "word_id").distinct()


def _flagged(words: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return words.join(found.select("session_id", "word_id").distinct().withColumn(name, F.lit(True)), ["session_id", "word_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def audio_pass(mic: DataFrame, evidence: DataFrame, room: DataFrame) -> DataFrame:
    """(session_id, word_id) of words whose levels follow the remote side's and are no louder than its echo.

    Explained words between two such of a phrase are marked as well; words in the
    room aren't, but for that.
    """
    rated = _flagged(with_phrases(mic), in_spans(mic, room), "_room").join(evidence.select("session_id", "word_id", "excess", "correlation"), ["session_id", "word_id"], "left")
    explained = F.coalesce(F.col("excess") <= WORD_EXCESS_LN, F.lit(False))
    passes = rated.withColumn("_explained", explained).withColumn("_echo", explained & F.coalesce(F.col("correlation") >= WORD_CORRELATION, F.lit(False)) & ~F.col("_room"))
    w = Window.partitionBy("session_id", "phrase").orderBy("start_ms", "end_ms", "word_id")
    between = F.coalesce(F.lag("_echo").over(w) & F.lead("_echo").over(w), F.lit(False)) & F.col("_explained")
    return passes.withColumn("_marked", F.col("_echo") | between).where("_marked").select("session_id", "word_id")


def matched_phrases(mic: DataFrame, system: DataFrame, room: DataFrame) -> DataFrame:
    """Phrases with the system words that say the same: (session_id, phrase, words, matches, similarity, system_start, system_end, delay_ms, deviation_ms).

    ``words`` are the microphone's matched ones. A phrase meets the system's
    words about its time, so both lists are bounded by its span.
    """
    token = lambda rows: rows.withColumn("token", X.normalize_token(F.col("text"))).where("token IS NOT NULL")
    spoken = _flagged(with_phrases(mic), in_spans(mic, room), "_room")
    spans = spoken.groupBy("session_id", "phrase").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    mine = token(spoken.where("NOT _room")).groupBy("session_id", "phrase").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "word_id", "token"))).alias("mine")).where(F.size("mine") >= AUDIO_MATCHES)
    near = range_join(spans.join(mine.select("session_id", "phrase"), ["session_id", "phrase"]), token(system).select("session_id", "word_id", "start_ms", "end_ms", "token"), (F.col("start_ms") - EARLY_MS, F.col("end_ms") + LATE_MS), (F.col("start_ms"), F.col("end_ms")), keys=("session_id",))
    said = near.groupBy("session_id", "phrase").agg(F.sort_array(F.collect_list(F.struct("r_start_ms", "r_end_ms", "r_word_id", "r_token"))).alias("said")).where(F.size("said") >= AUDIO_MATCHES)
    schema = "session_id long, phrase long, words array<long>, matches int, similarity double, system_start long, system_end long, delay_ms long, deviation_ms long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for session, phrase, a, b in zip(batch["session_id"], batch["phrase"], batch["mine"], batch["said"]):
                pairs = align([x["token"] for x in a], [x["r_token"] for x in b])
                if len(pairs) >= AUDIO_MATCHES:
                    delay, deviation = timing([(a[i]["start_ms"], b[j]["r_start_ms"]) for i, j in pairs])
                    out.append((session, phrase, [a[i]["word_id"] for i, _ in pairs], len(pairs), len(pairs) / min(len(a), len(b)), min(b[j]["r_start_ms"] for _, j in pairs), max(b[j]["r_end_ms"] for _, j in pairs), delay, deviation))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return mine.join(said, ["session_id", "phrase"]).mapInPandas(run, schema)


def span_correlations(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """(session_id, phrase, r, lag_ms): how well the microphone follows the system's levels over each span, at the best delay."""
    key = F.struct("session_id", "phrase")
    own = spans.select("session_id", "phrase", F.explode(F.expr(f"sequence(system_start DIV {FRAME_MS}, greatest(system_start, system_end - 1) DIV {FRAME_MS})")).alias("frame"))
    system = own.join(frames.where("source = 'system'"), ["session_id", "frame"]).select(key.alias("k"), F.lit("system").alias("source"), "frame", "rms")
    reach = own.groupBy("session_id", "phrase").agg((F.min("frame") + DELAY_FRAMES[0]).alias("_lo"), (F.max("frame") + DELAY_FRAMES[-1]).alias("_hi")).withColumn("frame", F.explode(F.sequence(F.greatest("_lo", F.lit(0)), "_hi")))
    mic = reach.join(frames.where("source = 'mic'"), ["session_id", "frame"]).select(key.alias("k"), F.lit("mic").alias("source"), "frame", "rms")
    found = lag_correlations(system.unionByName(mic).withColumnRenamed("k", "session_id"), list(DELAY_FRAMES)).where("r IS NOT NULL")
    best = found.groupBy("session_id").agg(F.max("r").alias("r"), F.max_by("lag", F.struct("r", "lag")).alias("lag"))
    return best.select("session_id.session_id", "session_id.phrase", "r", (F.col("lag") * FRAME_MS).alias("lag_ms"))


def text_pass(mic: DataFrame, system: DataFrame, room: DataFrame, frames: DataFrame | None) -> DataFrame:
    """(session_id, word_id) of words in phrases that repeat the system's, by their text alone or, with levels, by both."""
    found = matched_phrases(mic, system, room)
    timed = (F.col("deviation_ms") <= DEVIATION_MS) & (F.col("system_end") - F.col("system_start") >= MATCHED_MS)
    if frames is None:
        fine = timed & (F.col("matches") >= TEXT_MATCHES) & (F.col("similarity") >= TEXT_SIMILARITY) & F.col("delay_ms").between(*TEXT_DELAY_MS)
    else:
        likely = found.where(timed & (F.col("similarity") >= AUDIO_SIMILARITY))
        found = likely.join(span_correlations(likely, frames), ["session_id", "phrase"])
        fine = (F.col("r") >= AUDIO_CORRELATION) & (F.abs(F.col("delay_ms") - F.col("lag_ms")) <= DELAY_DIFFERENCE_MS)
    return found.where(fine).select("session_id", F.explode("words").alias("word_id"))


def lead_pass(mic: DataFrame, leads: DataFrame, room: DataFrame, echo_voices: DataFrame) -> DataFrame:
    """(session_id, word_id) of words most of whose led frames the system leads; less will do where the voice sounds like a remote one."""
    spread = mic.withColumn("frame", F.explode(F.expr(f"sequence(start_ms DIV {FRAME_MS}, greatest(start_ms, end_ms - 1) DIV {FRAME_MS})")))
    led = spread.join(leads.where("lead IS NOT NULL").select("session_id", "frame", "lead"), ["session_id", "frame"]).groupBy("session_id", "word_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lead") == "system").alias("system"))
    rated = _flagged(_flagged(mic, in_spans(mic, room), "_room"), in_spans(mic, echo_voices), "_voice").join(led, ["session_id", "word_id"])
    share = F.when(F.col("_voice"), VOICE_LEAD_SHARE).otherwise(LEAD_SHARE)
    return rated.where(~F.col("_room") & (F.col("n") >= LEAD_FRAMES) & (F.col("system") >= share * F.col("n"))).select("session_id", "word_id")


def echo_words(words: DataFrame, room: DataFrame, echo_voices: DataFrame, evidence: DataFrame | None = None, frames: DataFrame | None = None, leads: DataFrame | None = None) -> DataFrame:
    """(session_id, word_id, pass) of the microphone words that are an echo of the system's.

    Without levels (``evidence``, ``frames``, ``leads``) only texts are compared.
    What a pass marks is stored, as the plans of the later passes hold it several times.
    Phrases of the later passes are built of the words that are left. ``room``
    and ``echo_voices`` (session_id, start_ms, end_ms) are spans in which someone
    in the room talks, and turns that sound like a remote voice.
    """
    mic, system = (words.where(F.col("source") == s).select("session_id", "word_id", "start_ms", "end_ms", "text") for s in ("mic", "system"))
    marked = mic.select("session_id", "word_id").limit(0).withColumn("pass", F.lit(""))

    def add(found: DataFrame, name: str) -> DataFrame:
        return marked.unionByName(stored(found.distinct().withColumn("pass", F.lit(name)), "echo"))

    left = lambda: mic.join(marked.select("session_id", "word_id"), ["session_id", "word_id"], "left_anti")
    if evidence is not None:
        marked = add(audio_pass(mic, evidence, room), "audio")
    marked = add(text_pass(left(), system, room, frames), "text" if frames is None else "text_audio")
    if leads is not None:
        marked = add(lead_pass(left(), leads, room, echo_voices), "lead")
    return marked
