"""Speakers of a recording: clusters of local voices, their turns, and the people that they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions import scalars as X
from timeweave.operators import vectors as V
from timeweave.operators.alignment import assign_window
from timeweave.operators.intervals import other_voice_chunks, range_join
from timeweave.operators.vectors import mean_normalized

TRACK = ("session_id", "source")
#: Fixed values of the model: seconds of clean speech to train on, the least cluster and its share, new voices' share, rounds and seconds.
TRAINING_SECONDS, LEAST_CLUSTER, CLUSTER_SHARE = 2.0, 3, 0.02
NEW_SHARE, NEW_ROUNDS, NEW_SECONDS = 0.05, 3, 0.6
LEAST_LEARN_MS = 1_500
SAME_VECTOR = 0.999


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def trained_centres(v: np.ndarray, clean: np.ndarray, threshold: float, count: int | None = None) -> np.ndarray:
    """M6, M7: centres of the clusters of voices with clean speech enough, or of all if fewer than two have."""
    chosen = np.flatnonzero(clean >= TRAINING_SECONDS)
    if len(chosen) < 2:
        chosen = np.arange(len(v))
    own = v[chosen[V.spread_evenly(len(chosen), V.MOST_CLUSTERED)]]
    if not len(own):
        return np.zeros((0, v.shape[1] if v.ndim == 2 else 0))
    least = LEAST_CLUSTER if count is not None else max(LEAST_CLUSTER, int(CLUSTER_SHARE * len(own)))
    return V.centres_of(own, V.absorb_small(own, V.agglomerate(own, None if count is not None else threshold, count), least))


def matched(chunks: np.ndarray, v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cluster of each voice, those of a window apart; -1 where the window has more voices than there are clusters."""
    out, scores = np.full(len(v), -1), v @ centres.T
    for window in np.split(np.arange(len(v)), np.flatnonzero(np.diff(chunks)) + 1):
        if len(window):
            out[window] = [-1 if c is None else c for c in assign_window(scores[window])]
    return out


def with_new_voices(chunks: np.ndarray, v: np.ndarray, has: np.ndarray, seconds: np.ndarray, centres: np.ndarray, threshold: float) -> np.ndarray:
    """M8: centres, with those of voices that found no cluster in their window and are far from all, in a few rounds.

    A group of them becomes a cluster if it has share enough, and two voices or
    one that speaks long enough.
    """
    for _ in range(NEW_ROUNDS):
        far = (1 - v @ centres.T > threshold).all(axis=1)
        left = np.flatnonzero((matched(chunks, v, centres) < 0) & far & has)
        left = left[V.spread_evenly(len(left), V.MOST_CLUSTERED)]
        if not len(left):
            break
        labels = V.agglomerate(v[left], threshold)
        size, longest = np.bincount(labels), np.zeros(labels.max() + 1)
        np.maximum.at(longest, labels, seconds[left])
        fine = (size >= NEW_SHARE * len(left)) & ((size >= 2) | (longest >= NEW_SECONDS))
        if not fine.any():
            break
        centres = np.concatenate([centres, V.centres_of(v[left], labels)[fine]])
    return centres


def local_speakers(items: DataFrame, threshold: float, count: int | None = None) -> DataFrame:
    """(session_id, source, chunk, local, cluster) of local voices (.., clean_s, active_s, v).

    A track is clustered as a whole, as the model does: its windows are those of
    one recording, and what is clustered at once has the model's bound. Voices
    without a vector, and those left over in their window, go to the first and
    to the most similar cluster. A track without any vector has no rows.
    """

    def run(key: tuple, track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values(["chunk", "local"], ignore_index=True)
        has = track["v"].notna().to_numpy()
        columns = {"session_id": key[0], "source": key[1], "chunk": track["chunk"], "local": track["local"]}
        if not has.any():
            return pd.DataFrame(columns | {"cluster": 0}).iloc[:0]
        width = len(track["v"][has].iloc[0])
        v = _unit(np.array([x if ok else np.zeros(width) for x, ok in zip(track["v"], has)], dtype=float))
        centres = trained_centres(v[has], track["clean_s"].to_numpy()[has], threshold, count)
        chunks = track["chunk"].to_numpy()
        if count is None:
            centres = with_new_voices(chunks, v, has, track["active_s"].to_numpy(), centres, threshold)
        found = matched(chunks, v, centres)
        return pd.DataFrame(columns | {"cluster": np.where(found < 0, (v @ centres.T).argmax(axis=1), found)})

    return items.groupBy(*TRACK).applyInPandas(run, "session_id long, source string, chunk long, local int, cluster int")


def voice_turns(activity: DataFrame, speakers: DataFrame, frames: DataFrame, gap_frames: int = 30, frame_ms: int = 17, end_ms: int | None = None) -> DataFrame:
    """(session_id, source, cluster, start_ms, end_ms) from windows' active local voices.

    ``activity`` has a row for each (chunk, local, frame) that speaks, ``frames``
    how many speakers and windows (speakers, windows) each frame has: as many
    clusters as windows see on average are kept, those with most votes. Frames
    of a cluster nearer than ``gap_frames`` are one turn, cut at the end.
    """
    votes = activity.join(speakers, [*TRACK, "chunk", "local"]).groupBy(*TRACK, "frame", "cluster").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy(*TRACK, "frame").orderBy(F.col("votes").desc(), "cluster"))
    kept = votes.withColumn("_r", rank).join(frames, [*TRACK, "frame"]).where(F.col("_r") <= F.floor(F.col("speakers") / F.col("windows") + 0.5))
    w = Window.partitionBy(*TRACK, "cluster").orderBy("frame")
    before = F.lag("frame").over(w)
    starts = kept.withColumn("_new", (before.isNull() | (F.col("frame") - before - 1 >= gap_frames)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    turns = starts.groupBy(*TRACK, "cluster", "_run").agg((F.min("frame") * frame_ms).alias("start_ms"), ((F.max("frame") + 1) * frame_ms).alias("end_ms")).drop("_run")
    if end_ms is not None:
        turns = turns.withColumn("start_ms", F.least("start_ms", F.lit(end_ms))).withColumn("end_ms", F.least("end_ms", F.lit(end_ms)))
    return turns.where("end_ms > start_ms")


def used_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks long enough; those in which other voices speak only where a cluster has no others."""
    long = other_voice_chunks(chunks).where(F.col("end_ms") - F.col("start_ms") >= LEAST_LEARN_MS)
    alone = F.min(F.col("crowded").cast("int")).over(Window.partitionBy(*TRACK, "cluster")) == 1
    return long.withColumn("used", ~F.col("crowded") | alone).where("used").drop("used", "other_ms")


def recognized(chunks: DataFrame, samples: DataFrame, threshold: float, allowed: DataFrame | None = None) -> DataFrame:
    """(session_id, source, cluster, best_candidate, score, speaker) of every cluster.

    The five people closest to a cluster's centre (of ``allowed`` (session_id,
    source, name), where given) are scored by the median over its chunks of the
    mean of the three most similar samples; the best is the speaker from the
    threshold. Clusters without a usable chunk or candidate have nulls.
    """
    used = used_chunks(chunks)
    cluster = F.struct(*TRACK, "cluster").alias("query_id")
    centres = mean_normalized(used, (*TRACK, "cluster")).where("centroid IS NOT NULL").select(cluster, F.col("centroid").alias("q"))
    may = None if allowed is None else centres.join(allowed, (F.col("query_id.session_id") == allowed["session_id"]) & (F.col("query_id.source") == allowed["source"])).select("query_id", "name").distinct()
    near = V.centroid_prefilter(centres, mean_normalized(samples, ("name",)), 5, may).select(F.col("query_id").alias("of"), "name")
    asked = used.select(F.struct(*TRACK, "cluster").alias("of"), F.struct(*TRACK, "cluster", "seg_id").alias("query_id"), F.col("v").alias("q")).join(near, "of")
    scores = V.topk_scores(asked.select("query_id", "name", "q"), samples)
    rated = V.speaker_scores(scores.select(F.struct("query_id.session_id", "query_id.source", "query_id.cluster").alias("cluster"), "name", "score"))
    best = V.best_candidate(rated, "cluster").select("cluster.*", F.col("name").alias("best_candidate"), "score")
    speaker = F.when(F.col("score") >= threshold, F.col("best_candidate"))
    return chunks.select(*TRACK, "cluster").distinct().join(best, [*TRACK, "cluster"], "left").withColumn("speaker", speaker)


def learned_lines(lines: DataFrame, chunks: DataFrame, groups: DataFrame, samples: DataFrame) -> DataFrame:
    """(session_id, source, line_id) of locked lines outside groups of which a learnable chunk equals a sample stored under the line's name."""
    from timeweave.operators.intervals import learnable

    own = lines.where("locked AND group_id IS NULL")
    taught = learnable(chunks, own.select(*TRACK, "line_id", "start_ms", "end_ms"), groups.select(*TRACK, "start_ms", "end_ms"), LEAST_LEARN_MS)
    voices = taught.select(*TRACK, "seg_id", "line_id").join(chunks.select(*TRACK, "seg_id", "v"), [*TRACK, "seg_id"]).join(own.select(*TRACK, "line_id", F.col("speaker").alias("name")), [*TRACK, "line_id"])
    closest = V.topk_scores(voices.select(F.struct(*TRACK, "line_id", "seg_id").alias("query_id"), "name", F.col("v").alias("q")), samples, 1)
    return closest.where(F.col("score") >= SAME_VECTOR).select("query_id.session_id", "query_id.source", "query_id.line_id").distinct()


def placed_lines(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """``line_start``, where a line belongs: its group's start, else its own."""
    starts = groups.groupBy("session_id", "group_id").agg(F.min("start_ms").alias("_start"))
    return lines.join(starts, ["session_id", "group_id"], "left").withColumn("line_start", F.coalesce("_start", "start_ms")).drop("_start")


def forgotten_samples(samples: DataFrame, chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Samples without those learned in a session and source from a chunk that reaches into a line that was cut there."""
    met = range_join(chunks, cuts, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), F.col("end_ms"))).where("start_ms < r_end_ms AND r_start_ms < end_ms")
    vectors = met.select(F.col("session_id").alias("session"), "source", F.col("v").alias("_cut")).distinct()
    gone = samples.join(vectors, ["session", "source"]).where(X.dot(F.col("v"), F.col("_cut")) >= SAME_VECTOR).select("name", "sample_no").distinct()
    return samples.join(gone, ["name", "sample_no"], "left_anti")
