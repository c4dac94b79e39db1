"""Literal cases of the interval and sequence operators."""

from pyspark.sql import functions as F

from timeweave.operators import intervals as I
from timeweave.operators import sequences as Q

WORD = "session_id long, source string, word_id long, start_ms long, end_ms long, text string"
SEG = "session_id long, source string, seg_id long, start_ms long, end_ms long, cluster int"


def words(spark, *rows):
    return spark.createDataFrame([(1, r[0], k, r[1], r[2], r[3] if len(r) > 3 else "w") for k, r in enumerate(rows)], WORD)


def segments(spark, *rows):
    return spark.createDataFrame([(1, r[0], k, r[1], r[2], r[3]) for k, r in enumerate(rows)], SEG)


def test_overlap_ties_and_nearest(spark):
    s = segments(spark, ("mic", 0, 100, 7), ("mic", 100, 200, 3), ("mic", 1000, 1100, 5), ("system", 0, 5000, 9))
    w = words(spark, ("mic", 50, 150), ("mic", 210, 260), ("mic", 590, 600), ("mic", 599, 700), ("mic", 701, 701), ("mic", 30_000, 30_010))
    got = {r.word_id: r.cluster for r in I.assign_cluster(w, s).collect()}
    assert got == {0: 7, 1: 3, 2: 3, 3: 5, 4: 5, 5: None}
    assert I.assign_cluster(w, s.limit(0)).where("cluster IS NULL").count() == 6


def test_recognized_clusters_take_no_number(spark):
    s = segments(spark, ("system", 0, 10, 1), ("mic", 0, 10, 2), ("mic", 5, 10, 1))
    known = spark.createDataFrame([(1, "mic", 2)], "session_id long, source string, cluster int")
    assert {(r.source, r.cluster): r.name for r in I.anonymous_names(s, known).collect()} == {("system", 1): "SPEAKER_00", ("mic", 1): "SPEAKER_01"}


def test_locks_beat_inferred_and_the_newest_wins(spark):
    c = spark.createDataFrame([(1, "mic", 1, 0, 100, "old", False), (1, "mic", 2, 0, 100, "new", False), (1, "mic", 3, 0, 100, "guess", True), (1, "mic", 4, 200, 300, "guess", True)], "session_id long, source string, ordinal int, start_ms long, end_ms long, speaker string, inferred boolean")
    got = {r.word_id: (r.speaker, r.locked) for r in I.overlay_corrections(words(spark, ("mic", 100, 100), ("mic", 250, 260), ("mic", 101, 102)), c).collect()}
    assert got == {0: ("new", True), 1: ("guess", False), 2: (None, False)}


def test_merge_and_subtract(spark):
    s = segments(spark, ("mic", 0, 10, 1), ("mic", 10, 20, 1), ("mic", 22, 30, 1), ("mic", 5, 8, 2))
    assert sorted((r.start_ms, r.end_ms) for r in I.merge_intervals(s).collect()) == [(0, 20), (22, 30)]
    assert sorted((r.start_ms, r.end_ms) for r in I.merge_intervals(s, gap_ms=2).collect()) == [(0, 30)]
    cut = spark.createDataFrame([(1, "mic", 3, 6)], "session_id long, source string, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in I.subtract(s, cut).collect()) == [(0, 2), (7, 8), (7, 10), (10, 20), (22, 30)]


def test_two_speakers_at_once(spark):
    bars = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 50, 150), (1, 2, 150, 160), (1, 3, 60, 70)], "session_id long, lane int, start_ms long, end_ms long")
    got = sorted((r.start_ms, r.end_ms, r.lane_a, r.lane_b) for r in I.overlap_sweep(bars).collect())
    assert got == [(50, 100, 1, 2)]


def line(spark, *rows):
    full = [(1, "mic", k, r[0], r[1], r[2], r[3], r[3], False, False, False, r[4] if len(r) > 4 else None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "session_id long, source string, word_id long, start_ms long, end_ms long, text string, speaker_id string, speaker string, locked boolean, kept boolean, echo boolean, turn string")


def test_lines_split_on_speaker_gap_and_long_sentences(spark):
    rows = [(0, 500, "Hello", "A"), (600, 900, ",", "A"), (950, 1000, "you", "B"), (2001, 2100, "there", "B"), (2200, 17_500, "long.", "B"), (17_600, 17_700, "Next", "B"), (17_800, 17_900, "x", "B", "1:0"), (30_000, 30_100, "y", "C", "1:0")]
    got = sorted((r.start_ms, r.end_ms, r.text, r.n_words) for r in Q.utterances(line(spark, *rows)).collect())
    assert got == [(0, 900, "Hello,", 2), (950, 1000, "you", 1), (2001, 17_500, "there long.", 2), (17_600, 17_700, "Next", 1), (17_800, 30_100, "x y", 2)]


def test_phrases_break_on_gaps_and_span(spark):
    w = words(spark, ("mic", 0, 500), ("mic", 1400, 1500), ("mic", 2401, 2500), ("mic", 3000, 14_500), ("mic", 14_600, 14_700))
    assert sorted((r.start_ms, r.end_ms, r.n) for r in Q.phrases(w).collect()) == [(0, 1500, 2), (2401, 2500, 1), (3000, 14_700, 2)]


def test_speech_regions(spark):
    on = [*range(100, 120), *range(128, 140), *range(160, 180), *range(400, 405)]
    f = spark.createDataFrame([(1, "mic", k, 0.5) for k in on], "session_id long, source string, frame long, rms double")
    got = [(r.start_frame, r.end_frame) for r in Q.speech_regions(f, F.col("rms") > 0.1).collect()]
    assert got == [(85, 195)]


def test_every_word_is_in_one_route(spark):
    from timeweave.plans import interval_queries, sequence_queries

    sf = "/root/testdata/sf0.001"
    routed = interval_queries.line_routing(spark, sf)
    assert routed.count() == 1000 and routed.where("route IS NULL").count() == 0
    assert sequence_queries.utterances_full(spark, sf).agg(F.sum("n_words")).first()[0] == 1000
