"""Changes to sessions and stores, and recording of tracks, against literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.operators import changes as C
from timeweave.streaming import capture


def test_joined_tracks_against_concatenation(spark):
    r = random.Random(3)
    pieces = [(1, 0, 10.0, 37), (1, 1, 5.0, 20_000), (1, 2, 30.0, 16_384), (2, 0, 0.0, 5)]
    tracks = {(m, p, s): [float(np.float32(r.random() + 0.1)) for _ in range(n if s == "mic" else n - 3)] for m, p, _, n in pieces for s in (("mic", "system") if p != 2 else ("mic",))}
    block = 1000
    rows = [(m, p, s, k // block, x[k : k + block]) for (m, p, s), x in tracks.items() for k in range(0, len(x), block)]
    blocks = spark.createDataFrame(rows, "merge_id long, piece long, source string, block long, samples array<float>")
    placed = C.placements(spark.createDataFrame(pieces, "merge_id long, piece long, start_s double, samples long"))
    assert {(x.merge_id, x.piece): x.offset for x in placed.collect()} == {(1, 1): 0, (1, 0): 36_000, (1, 2): 36_000 + 37 + 16_000, (2, 0): 0}
    joined = C.joined_track(blocks, placed, block)
    got = {}
    for x in joined.orderBy("merge_id", "source", "block").collect():
        assert len(x.samples) == block or x.block == (68_421 - 1) // block or x.merge_id == 2
        got.setdefault((x.merge_id, x.source), []).extend(x.samples)
    silence = [0.0] * 16_000
    own = lambda p, s, n: tracks.get((1, p, s), []) + [0.0] * (n - len(tracks.get((1, p, s), [])))
    for s in ("mic", "system"):
        assert got[1, s] == own(1, s, 20_000) + silence + own(0, s, 37) + silence + own(2, s, 16_384)
    assert got[2, "mic"] == tracks[2, 0, "mic"] and got[2, "system"] == tracks[2, 0, "system"] + [0.0] * 3
    assert C.track_faults(joined, blocks, placed, block).count() == 0
    broken = joined.withColumn("samples", F.when((F.col("merge_id") == 2) & (F.col("source") == "mic"), F.array([F.lit(9.0).cast("float")] * 5)).otherwise(F.col("samples")))
    assert C.track_faults(broken, blocks, placed, block).count() == 5


def test_learning_forgets_admits_and_holds_once(spark):
    v = lambda *x: [float(i) for i in x]
    schema = "name string, sample_no long, session int, v array<double>"
    store = spark.createDataFrame([("Ann", 1, 1, v(1, 0)), ("Ann", 2, 1, v(0, 1)), ("Bob", 3, 1, v(-1, 0))], schema)
    old = spark.createDataFrame([("Ann", v(0, 1)), ("Cid", v(1, 0))], "name string, v array<double>")
    new = spark.createDataFrame([("Bob", 10, 2, v(0, 1)), ("Bob", 11, 2, v(0, 1)), ("Bob", 12, 2, v(-1, 0))], schema)
    got = {(r.name, r.sample_no) for r in C.learned(store, old, new, 0.5).collect()}
    assert got == {("Ann", 1), ("Bob", 3), ("Bob", 10)}


def test_names_are_carried_forward_but_take_no_locks_place(spark):
    corrections = spark.createDataFrame([(1, "mic", 1, 100, 200, "Ann", False)], "session_id long, source string, ordinal long, start_ms long, end_ms long, speaker string, inferred boolean")
    lines = spark.createDataFrame(
        [(1, "mic", k, 0, a, a + 50, False, "SPEAKER_00", 0.9, 0.1) for k, a in enumerate((0, 120, 300, 500))] + [(1, "mic", 9, 0, 700, 750, False, "SPEAKER_00", 0.2, 0.1)],
        "session_id long, source string, line_id long, cluster int, start_ms long, end_ms long, locked boolean, speaker string, new_score double, old_score double",
    )
    request = spark.createDataFrame([(1, 0, 50, "Bob")], "session_id long, cluster int, end_ms long, speaker string")
    got = sorted((r.start_ms, r.speaker, r.inferred) for r in C.carried_forward(corrections, lines, request, 0.5).collect())
    assert got == [(100, "Ann", False), (300, "Bob", True), (500, "Bob", True)]


def test_kept_ranges_that_end_before_they_start_are_refused(spark):
    schema = "session_id long, source string, start_ms long, end_ms long"
    rules, added, removed = (spark.createDataFrame(x, schema) for x in ([(1, "mic", 0, 10), (1, "mic", 50, 60)], [(1, "mic", 11, 20), (1, "mic", 9, 8)], [(1, "mic", 50, 60)]))
    assert [tuple(r) for r in C.changed_rules(rules, added, removed).select("start_ms", "end_ms").collect()] == [(0, 20)]
    assert [(r.start_ms, r.refused) for r in C.refused_ranges(added).collect()] == [(9, "a kept range must not end before it starts")]
    details = spark.createDataFrame([(1, 2, "t", ["x"])], "session_id long, format_version int, title string, remote array<string>")
    with pytest.raises(Exception, match="unsupported format_version 2"):
        C.changed_details(details, spark.createDataFrame([(1, "n", None)], "session_id long, title string, remote array<string>")).collect()


def test_a_track_that_fails_leaves_the_others_alone(spark, tmp_path):
    schema = "session_id long, source string, seq long, capture_ns long, samples long, started_ns long"
    spark.createDataFrame([(1, "mic", k, k * 128_000_000, 2048, 0) for k in range(5)], schema).write.parquet(f"{tmp_path}/in")
    good = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    bad = good.withColumn("seq", F.raise_error(F.lit("device lost")).cast("long"))
    failed = capture.record_tracks({"mic": good, "system": bad}, f"{tmp_path}/out", f"{tmp_path}/state", seconds=None)
    assert failed["mic"] is None and "device lost" in failed["system"]
    assert spark.read.parquet(f"{tmp_path}/out/mic").count() == 5
    with pytest.raises(RuntimeError, match="all tracks failed"):
        capture.record_tracks({"system": bad}, f"{tmp_path}/out2", f"{tmp_path}/state2", seconds=None)


def test_new_samples_that_share_a_number_are_judged_each(spark):
    from timeweave.operators.sessions import upsert_learned

    rows = lambda *x: spark.createDataFrame(list(x), "sample_no long, v array<double>")
    a, b, c = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]
    got = upsert_learned(rows((1, a), (7, b)), rows((7, a), (7, c), (8, c), (7, b), (9, [0.0, -1.0]))).collect()
    assert sorted((x.sample_no, x.v) for x in got) == [(7, c), (9, [0.0, -1.0])]


def test_ancestors_beyond_a_million_rows(spark):
    from timeweave.operators.sessions import ancestors

    links = spark.range(3, 200_000).selectExpr("id AS child", "id DIV 3 AS parent")
    depth, want = [0, 0, 0], 0
    for k in range(3, 200_000):
        depth.append(depth[k // 3] + 1)
        want += depth[k]
    assert ancestors(links).count() == want > 1_000_000
    assert sorted(map(tuple, ancestors(spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), 3).collect())) == [(1, 1, 2), (1, 2, 1), (1, 2, 3), (2, 1, 1), (2, 1, 3), (2, 2, 2)]
