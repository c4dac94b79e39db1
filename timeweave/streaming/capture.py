"""Structured Streaming operators on live capture: clock placement, levels, file watching, control messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
TOLERANCE, MOST_FILL, OVERLAP_LIMIT = 480, 60 * SAMPLE_RATE, 4_000
PLACED = "session_id long, source string, seq long, at_sample long, samples long, silence long, event string, amount long"
_STATE = "written long, started_ns long, pending boolean, last_seq long"
TRACK = ["session_id", "source"]


def place(state: tuple[int, int, bool, int] | None, seq: int, capture_ns: int, samples: int, started_ns: int = 0) -> tuple[tuple[int, int, bool, int], list[tuple]]:
    """Where a block goes, and the events this makes.

    Clocks count from the recording's start, so a track that starts later begins
    with silence. A block whose clock is ahead of what is written waits for the
    next to confirm the gap, which is then filled; no fill is longer than a
    minute. A late block goes to the present end; only a long overlap is an
    event. A hole in the sequence is a drop.
    """
    written, started, pending, last = state or (0, started_ns, False, seq - 1)
    expected = max(0, capture_ns - started) * SAMPLE_RATE // 1_000_000_000
    if state is None:
        silence = min(expected, MOST_FILL)
        return (silence + samples, started, False, seq), [(seq, silence, samples, silence, "start", expected)]
    out, silence, gap = [], 0, expected - written
    if seq > last + 1:
        out.append((seq, written, 0, 0, "dropped", seq - last - 1))
    if gap > TOLERANCE and pending:
        silence = min(gap, MOST_FILL)
        out.append((seq, written, 0, silence, "gap", silence))
    elif -gap > OVERLAP_LIMIT:
        out.append((seq, written, 0, 0, "overlap", -gap))
    pending = gap > TOLERANCE and not pending
    out.append((seq, written + silence, samples, silence, "block", 0))
    return (written + silence + samples, started, pending, max(seq, last)), out


def _placements(key: tuple, now: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """The state after a track's blocks, which are taken in the order of their sequence, and their placements."""
    out = []
    for seq, capture_ns, samples, started_ns in rows.sort_values("seq")[["seq", "capture_ns", "samples", "started_ns"]].itertuples(index=False):
        now, made = place(now, int(seq), int(capture_ns), int(samples), int(started_ns))
        out += [(*key, *m) for m in made]
    return now, pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """Placements and events of a stream of blocks (session_id, source, seq, capture_ns, samples, started_ns); state by track.

    The state carries the track's end, so late blocks are appended, never dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, placed = _placements(key, state.get if state.exists else None, pd.concat(list(batches)))
        state.update(now)
        yield placed

    return blocks.groupBy(*TRACK).applyInPandasWithState(run, PLACED, _STATE, "append", "NoTimeout")


def placed_batch(blocks: DataFrame) -> DataFrame:
    """The same placements of finished recordings, a track a task."""
    return blocks.groupBy(*TRACK).applyInPandas(lambda key, rows: _placements(key, None, rows)[1], PLACED)


def record_tracks(tracks: dict[str, DataFrame], path: str, checkpoint: str, seconds: float | None = 1.0) -> dict[str, str | None]:
    """Every track's placements written by a query of its own, flushed at least every ``seconds``; (track: error or None).

    A track that fails leaves the others alone; only if all fail is that an
    error. Without ``seconds`` what is there is recorded, and the recording ends.
    """
    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    running = {name: placed_blocks(blocks).writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(**when).start() for name, blocks in tracks.items()}
    failed: dict[str, str | None] = {}
    for name, stream in running.items():
        try:
            stream.awaitTermination()
            failed[name] = None
        except StreamingQueryException as error:
            failed[name] = str(error)
    if failed and all(failed.values()):
        raise RuntimeError(f"all tracks failed: {failed}")
    return failed


def live_levels(blocks: DataFrame) -> DataFrame:
    """T5: the highest level of each source so far, for update mode."""
    return blocks.groupBy("source").agg(F.max("peak").alias("peak"), F.max("seq").alias("seq"))


def watch_files(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as (path, time, size), so many a micro-batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select("path", F.col("modificationTime").alias("time"), F.col("length").alias("size"))


def control_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tagged JSON messages; what isn't one has a null tag."""
    parsed = F.from_json(column, "event string, language string, fraction double, message string")
    return lines.select(column, parsed.alias("m")).select(column, "m.*")


def processing_progress(rows: DataFrame) -> DataFrame:
    """Fraction done and speed against real time, pauses left out."""
    elapsed = F.greatest(F.col("elapsed_ms") - F.col("paused_ms"), F.lit(0))
    return rows.withColumn("fraction", F.least(F.greatest(F.col("done_ms") / F.nullif("total_ms", F.lit(0)), F.lit(0.0)), F.lit(1.0))).withColumn("speed", F.col("done_ms") / F.nullif(elapsed, F.lit(0)))
