"""Sources and sinks of sessions: JSON lines, documents, raw and 16-bit audio, speaker stores."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_RATE = 16_000
#: Artifact schemas, after the session's id.
SCHEMAS = {
    "words": "source STRING, start_ms BIGINT, end_ms BIGINT, text STRING",
    "segments": "source STRING, start_ms BIGINT, end_ms BIGINT, cluster INT",
    "chunks": "source STRING, start_ms BIGINT, end_ms BIGINT, cluster INT, embedding ARRAY<FLOAT>",
    "assignments": "source STRING, cluster INT, best_candidate STRING, score FLOAT, speaker STRING",
    "corrections": "ordinal INT, source STRING, start_ms BIGINT, end_ms BIGINT, speaker STRING, inferred BOOLEAN",
    "turn_groups": "source STRING, start_ms BIGINT, end_ms BIGINT, turns ARRAY<STRUCT<start_ms: BIGINT, speaker: STRING>>",
    "utterances": "start_ms BIGINT, end_ms BIGINT, source STRING, speaker_id STRING, speaker STRING, text STRING, locked BOOLEAN, echo BOOLEAN, group STRING, lead STRING",
    "timeline": "event STRING, sample BIGINT, time_ms BIGINT, missing_samples BIGINT, requested_samples BIGINT, blocks BIGINT, extra_samples BIGINT, message STRING",
    "screenshots": "time_ms BIGINT, file STRING, original STRING",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may hold wildcards, leads to something in any file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def read_lines(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line fails the read, a missing optional file is empty."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_correctable(spark: SparkSession, folder: str) -> DataFrame:
    """S3: transcript, lines outside the meeting and hidden lines as one relation."""
    parts = [read_lines(spark, f"{folder}/{name}.jsonl", SCHEMAS["utterances"], required=name == "transcript") for name in ("transcript", "outside-meeting", "hidden-lines")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines replaced as a whole by the job's commit."""
    df.write.mode("overwrite").json(path)


def append_lines(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends JSON lines, exactly once."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def read_document(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """Single JSON documents; a document of another ``format_version`` fails."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if version is None:
        return rows
    message = F.concat(F.lit("unsupported format_version "), F.coalesce(F.col("format_version").cast("string"), F.lit("none")))
    return rows.where(F.when(F.col("format_version") == version, True).otherwise(F.raise_error(message).cast("boolean")))


def read_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Meetings of all context files; malformed files and entries without title or start are left out."""
    entry = "title STRING, start STRING, `end` STRING, attendees ARRAY<STRING>"
    rows = spark.read.schema(f"format_version INT, meetings ARRAY<STRUCT<{entry.replace(' ', ': ', 1).replace(', start ', ', start: ').replace(', `end` ', ', `end`: ').replace(', attendees ', ', attendees: ')}>>, _bad STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    listed = rows.withColumn("file", F.input_file_name()).where("_bad IS NULL").select("file", F.posexplode("meetings").alias("entry", "m")).select("file", "entry", "m.*")
    return listed.where("trim(title) <> '' AND try_to_timestamp(start) IS NOT NULL")


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all session folders with the names of their artifacts, newest first."""
    schema = "state STRING, started_wallclock STRING, sample_rate INT, channels INT, sample_format STRING, local_speaker STRING"
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/manifest.json")
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    artifacts = spark.read.format("binaryFile").load(f"{root}/*/*").select(F.element_at(F.split("path", "/"), -2).alias("_folder"), F.element_at(F.split("path", "/"), -1).alias("_name"))
    held = artifacts.groupBy("_folder").agg(F.array_sort(F.collect_set("_name")).alias("artifacts"))
    found = rows.withColumn("session_id", folder).join(held, F.col("session_id") == F.col("_folder"), "left").drop("_folder")
    return found.orderBy(F.col("started_wallclock").desc(), "session_id")


def read_pcm(spark: SparkSession, path: str, block: int = 16_384) -> DataFrame:
    """(path, block, samples) of raw 32-bit little-endian audio, in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                x = np.frombuffer(content[: len(content) // 4 * 4], dtype="<f4")
                for k in range(0, len(x), block):
                    yield pd.DataFrame({"path": [name], "block": [k // block], "samples": [x[k : k + block].tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, block long, samples array<float>")


def pcm_samples(blocks: DataFrame, block: int = 16_384) -> DataFrame:
    """(path, pos, sample) rows of blocks."""
    return blocks.select("path", "block", F.posexplode("samples").alias("_i", "sample")).select("path", (F.col("block") * block + F.col("_i")).alias("pos"), "sample")


def wav_bytes(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """A mono 16-bit WAV file; samples are rounded and saturate."""
    data = np.clip(np.floor(np.asarray(samples, dtype=np.float64) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def write_wav(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wav) of tracks given as one array of samples each."""
    fields = [f for f in tracks.schema.fields if f.name in keys] + [T.StructField("wav", T.BinaryType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(wav=[wav_bytes(np.asarray(s)) for s in batch["samples"]])

    return tracks.select(*keys, "samples").mapInPandas(run, T.StructType(fields))


def wav_samples(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, sample) of mono 16-bit WAV files in ``wav``; samples are quantised numbers, chunks other than the data are skipped."""
    fields = [f for f in tracks.schema.fields if f.name in keys] + [T.StructField("samples", T.ArrayType(T.IntegerType()))]

    def decode(data: bytes) -> np.ndarray:
        if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
            raise ValueError("no WAV file")
        at, form = 12, None
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"fmt ":
                form = struct.unpack_from("<HHIIHH", data, at + 8)
            elif name == b"data":
                if form is None or (form[0], form[1], form[5]) != (1, 1, 16):
                    raise ValueError("no mono 16-bit samples")
                return np.frombuffer(data[at + 8 : at + 8 + size // 2 * 2], dtype="<i2")
            at += 8 + size + size % 2
        raise ValueError("no samples")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(samples=[decode(bytes(w)).tolist() for w in batch["wav"]])

    decoded = tracks.select(*keys, "wav").mapInPandas(run, T.StructType(fields))
    return decoded.select(*keys, F.posexplode("samples").alias("pos", "sample"))


def read_speakers(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a speaker store of any version, one row a sample.

    Version 3 has samples with their origin, version 2 bare vectors by name, and
    the unversioned form a map of names to vectors at the top.
    """
    raw = spark.read.text(path, wholetext=True)
    v = F.col("value")
    version = F.coalesce(F.get_json_object(v, "$.format_version").cast("int"), F.lit(1))
    sample = "struct<embedding:array<double>,session:string,source:string,learned_at:bigint,kept_by_user:boolean>"
    three = F.from_json(F.get_json_object(v, "$.speakers"), f"map<string,struct<samples:array<{sample}>>>")
    two = F.from_json(F.get_json_object(v, "$.speakers"), "map<string,array<array<double>>>")
    one = F.from_json(v, "map<string,array<array<double>>>")
    bare = lambda m: F.transform_values(m, lambda _, xs: F.transform(xs, lambda x: F.struct(x.alias("embedding"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("learned_at"), F.lit(None).cast("boolean").alias("kept_by_user"))))
    people = F.when(version == 3, F.transform_values(three, lambda _, p: p["samples"])).when(version == 2, bare(two)).otherwise(bare(one))
    return raw.select(version.alias("format_version"), F.explode(people).alias("name", "samples")).select("format_version", "name", F.posexplode("samples").alias("sample_no", "s")).select("format_version", "name", "sample_no", "s.*")


def write_speakers(samples: DataFrame, path: str, version: int = 3) -> None:
    """A speaker store of the present version as one document, which takes the old one's place.

    Samples of a person are in order; the writer is the one task of the
    document's row, so two writers can't mix their samples.
    """
    sample = F.struct("sample_no", "embedding", "session", "source", "learned_at", "kept_by_user")
    people = samples.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(sample)), lambda s: s.dropFields("sample_no")).alias("samples"))
    speakers = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct("samples")))))
    document = people.agg(speakers.alias("speakers")).select(F.lit(version).alias("format_version"), "speakers")
    staged = f"{path}.staged"
    document.coalesce(1).write.mode("overwrite").json(staged)
    swap_in(samples.sparkSession, staged, path)


def write_cases(clips: DataFrame, words: DataFrame, truths: DataFrame, path: str) -> None:
    """Labelled cases by folder: clips as 16-bit WAV, their words and truths as JSON lines; all of them take the old ones' place at once."""
    staged = f"{path}.staged"
    write_wav(clips, ["folder"]).write.mode("overwrite").parquet(f"{staged}/clips")
    write_lines(words, f"{staged}/words")
    write_lines(truths, f"{staged}/truths")
    swap_in(clips.sparkSession, staged, path)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of files, to be joined with what was recorded."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def swap_in(spark: SparkSession, staged: str, target: str) -> None:
    """A staged folder takes the place of the target; the old one comes back if that fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, target, f"{target}.previous"))
    fs = new.getFileSystem(conf)
    fs.delete(kept, True)
    had = fs.exists(old) and fs.rename(old, kept)
    if not fs.rename(new, old):
        if had:
            fs.rename(kept, old)
        raise OSError(f"{staged} couldn't take the place of {target}")
    fs.delete(kept, True)
