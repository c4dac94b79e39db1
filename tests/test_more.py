"""Streams, files, vectors and alignment against literal cases and brute force."""

import json
import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.operators import alignment as A
from timeweave.operators import sequences as Q
from timeweave.operators import sessions as M
from timeweave.operators import vectors as V
from timeweave.plans import more_queries
from timeweave.sources import files
from timeweave.streaming import capture

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(more_queries.stream_gap_fill(spark, SF)) == rows(more_queries.batch_gap_fill(spark, SF))


def test_a_gap_is_filled_when_the_next_block_confirms_it():
    state, out = capture.place(None, 0, 0, 2048)
    assert out == [(0, 0, 2048, 0, "start", 0)]
    state, out = capture.place(state, 1, 1_000_000_000, 2048)
    assert [o[5 - 1] for o in out] == ["block"] and state[2]
    state, out = capture.place(state, 2, 1_128_000_000, 2048)
    assert out[0][4] == "gap" and out[1][3] == out[0][3] > 0 and not state[2]
    state, out = capture.place(state, 9, 1_256_000_000, 2048)
    assert out[0][4:] == ("dropped", 6)


def test_tracks_start_with_the_recording_and_fills_have_a_bound():
    state, out = capture.place(None, 4, 2_000_000_000, 100, started_ns=1_000_000_000)
    assert out == [(4, 16_000, 100, 16_000, "start", 16_000)]
    assert capture.place(None, 0, 100_000_000_000, 10)[1] == [(0, 960_000, 10, 960_000, "start", 1_600_000)]
    # Within the tolerance nothing happens; a hole in the sequence alone fills nothing; a gap that isn't confirmed is forgotten.
    state, out = capture.place((16_000, 0, False, 0), 1, 1_030_000_000, 10)
    assert out == [(1, 16_000, 10, 0, "block", 0)] and not state[2]
    state, out = capture.place((16_000, 0, False, 0), 5, 2_000_000_000, 10)
    assert [o[4] for o in out] == ["dropped", "block"] and state[2]
    state, out = capture.place(state, 6, 1_000_000_000, 10)
    assert [o[4] for o in out] == ["block"] and not state[2]
    assert capture.place((16_000, 0, True, 0), 1, 500_000_000, 10)[1][0] == (1, 16_000, 0, 0, "overlap", 8_000)


def test_timeline_rows_take_every_line_that_covers_half(spark):
    lines = [(1, 1, "mic", 0, 10_000), (1, 2, "system", 1000, 3000), (1, 3, "system", 4000, 6000), (1, 4, "system", 7000, 7000), (1, 5, "mic", 9999, 20_000), (1, 6, "system", 30_000, 30_000), (1, 7, "mic", 30_000, 30_001)]
    got = Q.timeline_rows(spark.createDataFrame(lines, "session_id long, line_id long, source string, start_ms long, end_ms long"))
    assert {r.line_id: r.row for r in got.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 2, 7: 2}


def test_windows_keep_every_row(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(5, 4))
    items = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], "win long, row long, v array<double>")
    got = A.assigned_windows(items, np.eye(4)[:3]).collect()
    placed = A.assign_window(v @ np.eye(4)[:3].T)
    assert len(got) == 5 and sum(c is not None for c in placed) == 3 and sorted(c for c in placed if c is not None) == [0, 1, 2]
    assert {x.row: x.cluster for x in got} == {k: (int(v[k][:3].argmax()) if c is None else c) for k, c in enumerate(placed)}
    for rows, columns in ((1, 1), (2, 5), (3, 2), (4, 4), (3, 0), (4, 1)):
        s = r.normal(size=(rows, columns))
        n = min(rows, columns)
        best = max((sum(s[i, c] for i, c in zip(own, order)) for own in combinations(range(rows), n) for order in permutations(range(columns), n)), default=0.0)
        found = A.assign_window(s)
        assert len(found) == rows and sum(c is not None for c in found) == n and abs(sum(s[i, c] for i, c in enumerate(found) if c is not None) - best) < 1e-9


def test_latest_cut_of_tokens(spark):
    tokens = spark.createDataFrame([(1, k, t) for k, t in enumerate((0, 5, 10, 15, 30))], "line_id long, token long, start_ms long")
    cuts = spark.createDataFrame([(1, 5), (1, 12), (1, 30), (2, 0)], "line_id long, cut_ms long")
    assert {r.token: r.cut_ms for r in Q.token_turns(tokens, cuts, ["line_id"]).collect()} == {0: None, 1: 5, 2: 5, 3: 12, 4: 30}


def test_files(spark, tmp_path):
    p = str(tmp_path)
    assert files.read_lines(spark, f"{p}/none.jsonl", files.SCHEMAS["words"], required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_lines(spark, f"{p}/none.jsonl", files.SCHEMAS["words"])
    (tmp_path / "bad.jsonl").write_text('{"source": "mic", "start_ms": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast|bad"):
        files.read_lines(spark, f"{p}/bad.jsonl", files.SCHEMAS["words"]).collect()
    np.arange(20_000, dtype="<f4").tofile(tmp_path / "track.f32")
    blocks = files.read_pcm(spark, f"{p}/track.f32")
    assert blocks.count() == 2 and files.pcm_samples(blocks).agg(F.sum("sample")).first()[0] == sum(range(20_000))
    wav = files.wav_bytes(np.array([0.0, 1.0, -1.0, 0.5]))
    assert wav[:4] == b"RIFF" and np.frombuffer(wav[44:], "<i2").tolist() == [0, 32767, -32768, 16384]


def test_speaker_store_versions(spark, tmp_path):
    three = {"format_version": 3, "speakers": {"Ann": {"samples": [{"embedding": [1.0, 0.0], "session": "s1", "kept_by_user": True}]}}}
    for name, doc in (("3", three), ("2", {"format_version": 2, "speakers": {"Ann": [[1.0, 0.0]]}}), ("1", {"Ann": [[1.0, 0.0]]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        row = files.read_speakers(spark, f"{tmp_path}/{name}.json").collect()
        assert [(r.name, r.sample_no, r.embedding) for r in row] == [("Ann", 0, [1.0, 0.0])]
        assert row[0].session == ("s1" if name == "3" else None)


def test_swap_in(spark, tmp_path):
    for name in ("new", "old"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    files.swap_in(spark, f"{tmp_path}/new", f"{tmp_path}/old")
    assert (tmp_path / "old" / "x").read_text() == "new" and not (tmp_path / "new").exists()


def test_alignment_against_brute_force():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.choice(["yes", "hello", "hallo", "meeting", "meetings", "no"]) for _ in range(r.randint(0, 6))] for _ in "ab")
        got = A.align(a, b)
        assert all(A.tokens_match(a[i], b[j]) for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)

        def best(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(best(i + 1, j), best(i, j + 1), 1 + best(i + 1, j + 1) if A.tokens_match(a[i], b[j]) else 0)

        assert len(got) == best(0, 0)


def test_window_assignment():
    r = np.random.default_rng(1)
    for _ in range(50):
        s = r.normal(size=(r.integers(1, 4), r.integers(3, 6)))
        got = A.assign_window(s)
        assert abs(sum(s[i, c] for i, c in enumerate(got)) - max(sum(s[i, c] for i, c in enumerate(p)) for p in permutations(range(s.shape[1]), s.shape[0]))) < 1e-9


def circle(*degrees):
    return np.array([[np.cos(np.radians(d)), np.sin(np.radians(d))] for d in degrees])


def test_average_linkage_cuts_at_distance_or_count():
    v = circle(0, 5, 90, 95, 180)
    assert V.agglomerate(v, 0.1).tolist() == [0, 0, 1, 1, 2]
    assert V.agglomerate(v, count=2).tolist()[:2] == [0, 0]
    assert len(set(V.agglomerate(v, count=2).tolist())) == 2
    assert V.absorb_small(v, np.array([0, 0, 1, 1, 2]), 2).tolist() == [0, 0, 1, 1, 1]
    assert V.agglomerate(np.zeros((0, 2)), 0.1).tolist() == []


def test_layout_keeps_distances():
    points = np.random.default_rng(3).normal(size=(6, 2))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    assert V.layout(d)[1] < 1e-6


def test_a_pass_removes_a_tenth_and_keeps_twenty(spark):
    rows = [("a", k, float(k), "remove", 25) for k in range(25)] + [("b", k, float(k), "remove", 20) for k in range(20)]
    df = spark.createDataFrame(rows, "name string, sample_no long, severity double, verdict string, n_samples long")
    left = V.limit_removals(df).where("verdict = 'remove'").collect()
    assert sorted((r.name, r.sample_no) for r in left) == [("a", 23), ("a", 24)]


def test_quiet_needs_every_track_and_snapping(spark):
    rows = [(1, s, k, 0.5 if k in (0, 30) else 0.0) for s in ("mic", "system") for k in range(40)]
    levels = spark.createDataFrame(rows, "session_id long, source string, bucket long, rms double")
    quiet = Q.quiet_stretches(levels)
    assert [(r.start_ms, r.end_ms) for r in quiet.collect()] == [(50, 1500)]
    points = spark.createDataFrame([(1, 1, 100), (1, 2, 775), (1, 3, 9000)], "session_id long, point_id long, at_ms long")
    assert {r.point_id: r.snapped_ms for r in Q.snap_to_quiet(points, quiet).collect()} == {1: 775, 2: 775, 3: 775}


def test_spans_are_clipped_to_parts(spark):
    rows = spark.createDataFrame([(1, 0, 100), (2, 40, 60), (3, 60, 100)], "id long, start_ms long, end_ms long")
    got = sorted((r.id, r.part, r.start_ms, r.end_ms) for r in M.split_ranges(rows, 50).collect())
    assert got == [(1, 0, 0, 50), (1, 1, 0, 50), (2, 0, 40, 50), (2, 1, 0, 10), (3, 1, 10, 50)]


def test_oracles_have_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reference_points_against_all_pairs(spark):
    """Ties at one time, points at the midpoint, at the horizon and beyond it, and points without values."""
    from timeweave.operators.rules import reference_points

    r = random.Random(6)
    points = [(s, r.randrange(-200, 3000) // 10 * 10, r.choice([None, 1, 2, 3]), r.choice([None, 0.5, 1.5])) for s in (1, 2) for _ in range(90)]
    words = [(s, k + 1000 * s, r.randrange(0, 3000) // 10 * 10, None) for s in (1, 2, 3) for k in range(60)]
    words = [(s, k, a, a + r.choice([-5, 0, 20])) for s, k, a, _ in words]
    low = lambda x: (x is not None, x if x is not None else 0)
    want = {}
    for s, k, a, b in words:
        mid = a + max(b - a, 0) // 2
        for side in ("before", "after"):
            near = sorted((p for p in points if p[0] == s and abs(p[1] - mid) <= 100 and (p[1] <= mid) == (side == "before")), key=lambda p: (abs(p[1] - mid), p[1], low(p[2]), low(p[3])))[:3]
            middle = lambda c: (lambda x: x[len(x) // 2] if x else None)(sorted(p[c] for p in near if p[c] is not None))
            if near:
                want[k, side] = (middle(2), middle(3), len(near))
    got = reference_points(spark.createDataFrame(words, "session_id long, word_id long, start_ms long, end_ms long"), spark.createDataFrame(points, "session_id long, at_ms long, delay long, gain double"), 100).collect()
    assert len(got) == len(want) and {(x.word_id, x.side): (x.delay, x.gain, x.n) for x in got} == want


@pytest.mark.parametrize("delays", [(7, 3), (3, 7)])
def test_the_smallest_delay_of_a_place_counts_on_both_sides(spark, delays):
    from timeweave.operators.signals import nearest_point

    frames = spark.createDataFrame([(1, f) for f in (5, 10, 15, 40)], "session_id long, frame long")
    points = spark.createDataFrame([(1, 10, d) for d in delays], "session_id long, at long, delay int").coalesce(1)
    assert {r.frame: r.delay for r in nearest_point(frames, points, 20, 9).collect()} == {5: 3, 10: 3, 15: 3, 40: 9}
