"""Speakers, learned voices and small rules against literal cases and brute force."""

import itertools
import random

import numpy as np
import pytest

from timeweave.operators import recognition as N
from timeweave.operators import rules as R
from timeweave.operators import vectors as V


def unit(*rows):
    v = np.array(rows, dtype=float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plain_linkage(v, distance=None, count=None):
    """Average linkage by looking at all pairs of clusters in each step."""
    clusters = [[i] for i in range(len(v))]
    between = lambda a, b: float(np.mean([1 - v[i] @ v[j] for i in a for j in b]))
    while len(clusters) > (count or 1):
        d, i, j = min((between(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(clusters), 2))
        if count is None and d > distance:
            break
        clusters[i] += clusters.pop(j)
    order = sorted(clusters, key=min)
    return [next(k for k, c in enumerate(order) if i in c) for i in range(len(v))]


def test_linkage_by_chains_against_all_pairs():
    r = np.random.default_rng(6)
    for _ in range(40):
        v = unit(*r.normal(size=(r.integers(2, 14), 3)))
        for distance in (0.1, 0.5, 1.0):
            assert V.agglomerate(v, distance).tolist() == plain_linkage(v, distance)
        for count in (1, 2, 5):
            assert V.agglomerate(v, count=count).tolist() == plain_linkage(v, count=min(count, len(v)))
    same = unit(*[[1, 0]] * 6)
    assert len(set(V.agglomerate(same, count=3).tolist())) == 3


def test_large_groups_are_clustered_by_a_spread_part(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_CLUSTERED", 10)
    r = np.random.default_rng(2)
    who = [k % 7 % 3 for k in range(60)]
    v = unit(*[np.eye(3)[k] + r.normal(size=3) * 0.01 for k in who])
    rows = spark.createDataFrame([("g", k, x.tolist()) for k, x in enumerate(v)], "name string, sample_no long, v array<double>")
    got = {x.sample_no: x.label for x in V.clustered(rows, "name", 0.3).collect()}
    assert len(got) == 60 and all((got[i] == got[j]) == (who[i] == who[j]) for i in range(60) for j in range(60))


def test_voices_without_a_cluster_get_one_unless_they_match_one():
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    v, chunks, has, seconds = unit(a, b, a, [0.2, 1.0, 0.0]), np.array([0, 0, 1, 1]), np.ones(4, dtype=bool), np.ones(4)
    centres = N.with_new_voices(chunks, v, has, seconds, unit(a), 0.5)
    assert len(centres) == 2 and N.matched(chunks, v, centres).tolist() == [0, 1, 0, 1]
    split = unit(a, [1.0, 0.2, 0.0])
    assert len(N.with_new_voices(np.array([0, 0]), split, has[:2], seconds[:2], unit(a), 0.5)) == 1
    # One short voice isn't enough, one that speaks long enough is.
    alone = unit(a, b)
    assert len(N.with_new_voices(np.array([0, 0]), alone, has[:2], np.array([1.0, 0.3]), unit(a), 0.5)) == 1
    assert len(N.with_new_voices(np.array([0, 0]), alone, has[:2], np.array([1.0, 0.7]), unit(a), 0.5)) == 2


def test_speakers_of_a_track(spark):
    r = random.Random(1)
    voices = np.eye(4)
    rows = []
    for chunk in range(30):
        for local, who in enumerate(r.sample(range(3), 2)):
            rows.append((1, "mic", chunk, local, 2.5, 3.0, [float(x + r.gauss(0, 0.02)) for x in voices[who]], who))
    rows += [(1, "mic", 40, 0, 0.1, 0.2, None, None), (2, "system", 0, 0, 0.1, 0.2, None, None)]
    items = spark.createDataFrame([x[:7] for x in rows], "session_id long, source string, chunk long, local int, clean_s double, active_s double, v array<double>")
    for count in (None, 3):
        got = {(x.chunk, x.local): x.cluster for x in N.local_speakers(items, 0.5, count).collect()}
        assert len(got) == 61
        of = {}
        for x in rows[:60]:
            of.setdefault(x[7], set()).add(got[x[2], x[3]])
        assert all(len(s) == 1 for s in of.values()) and len(set.union(*of.values())) == 3


def test_prefilter_in_blocks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "CENTROID_BLOCK", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 11)
    r = np.random.default_rng(4)
    people, queries = {f"p{k:02}": x for k, x in enumerate(unit(*r.normal(size=(30, 5))))}, unit(*r.normal(size=(50, 5)))
    people["p30"] = people["p03"]
    got = V.centroid_prefilter(
        spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(queries)], "query_id long, q array<double>"), spark.createDataFrame([(n, c.tolist()) for n, c in people.items()], "name string, centroid array<double>"), 3
    ).collect()
    for k, q in enumerate(queries):
        want = sorted(people, key=lambda n: (-round(float(q @ people[n]), 12), n))[:3]
        assert [x.name for x in sorted((x for x in got if x.query_id == k), key=lambda x: x.rank)] == want


@pytest.mark.parametrize("threshold", [0.999, 0.9])
def test_near_vectors_against_all_pairs(spark, threshold):
    r = np.random.default_rng(5)
    v = unit(*r.normal(size=(60, 8)))
    v = np.concatenate([v, unit(*(v[:30] + r.normal(size=(30, 8)) * 0.01)), v[:5]])
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = sorted((x.a, x.b) for x in V.near_duplicates(rows, rows, threshold).collect())
    assert got == sorted((i, j) for i in range(len(v)) for j in range(len(v)) if i != j and v[i] @ v[j] >= threshold) and len(got) > 40


def test_marks_need_a_change_and_the_recording(spark):
    rows = spark.createDataFrame([(0, 5, 10, 0, 5), (0, 5, 10, 1, 5), (None, None, 10, 6, 6), (None, None, 10, 7, 11), (None, None, 0, 7, 11), (None, None, 10, None, 4), (None, None, 10, 10, None), (None, None, 10, None, None)], "a long, b long, n long, x long, y long")
    got = [r.m for r in rows.select(R.can_mark(rows.a, rows.b, rows.n, rows.x, rows.y).alias("m")).collect()]
    assert got == [False, True, False, False, True, True, False, False]


def test_verdicts_of_a_tidying_pass(spark):
    """Kept before recurring before settling before removal; a rival counts with samples enough, a person likewise."""
    r = np.random.default_rng(1)
    near = lambda v, n, spread: [unit(np.array(v) + r.normal(size=3) * spread)[0].tolist() for _ in range(n)]
    people = {"Ann": near([1, 0, 0], 40, 0.05), "Bob": near([0, 1, 0], 20, 0.05), "Cid": near([0, 0, 1], 5, 0.05)}
    rows = [(name, k, k % 9, v, False) for name, vs in people.items() for k, v in enumerate(vs)]
    # Strays of Ann that sound like Bob: of an old session, kept by the user, of the last session; and one like Cid, who has few samples.
    rows += [("Ann", 100, 0, near([0, 1, 0], 1, 0.01)[0], False), ("Ann", 101, 0, near([0, 1, 0], 1, 0.01)[0], True), ("Ann", 102, 8, near([0, 1, 0], 1, 0.01)[0], False)]
    samples = spark.createDataFrame(rows, "name string, sample_no long, session int, v array<double>, kept_by_user boolean")
    history = samples.select("name", "session").distinct().withColumn("pos", samples.session)
    got = {(x.name, x.sample_no): (x.reason, x.rival, x.verdict) for x in V.findings(V.review(samples, 0.6), samples, history, 0.6).collect()}
    assert got["Ann", 100] == ("sounds_like", "Bob", "remove") and got["Ann", 101][2] == "kept" and got["Ann", 102][2] == "settling"
    assert not any(name == "Cid" for name, _ in got) and all(v[2] != "remove" for k, v in got.items() if k[1] < 100 and v[0] == "sounds_like")


def test_neighbourhoods_in_blocks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "SAMPLE_BLOCK", 9)
    r = np.random.default_rng(8)
    v = unit(*r.normal(size=(60, 4)))
    rows = [("Ann" if k < 40 else "Bob", k, (k % 4 if k < 40 else int(k > 50)), x.tolist()) for k, x in enumerate(v)] + [("Ann", 99, None, v[3].tolist())]
    samples = spark.createDataFrame(rows, "name string, sample_no long, session int, v array<double>")
    got = {}
    for x in V.neighbourhoods(samples, 3, 10).collect():
        got.setdefault(x.sample_no, []).append((x.rank, x.other))
    for name, k, session, x in rows:
        others = [o for o in rows if o[0] == name and o[1] != k]
        foreign = [o for o in others if session is not None and o[2] is not None and o[2] != session]
        near = sorted(foreign if len(foreign) >= 10 else others, key=lambda o: (-round(float(np.dot(x, o[3])), 12), o[1]))[:3]
        assert [o for _, o in sorted(got[k])] == [o[1] for o in near], k


def test_best_scores_in_blocks_against_all_pairs(spark, monkeypatch):
    """Equal vectors, vectors of another length, and people without a comparable sample."""
    monkeypatch.setattr(V, "TOPK_BLOCK", 7)
    monkeypatch.setattr(V, "HELD_PRODUCTS", 20)
    r = np.random.default_rng(9)
    v = r.normal(size=(40, 3)).tolist()
    rows = [("Ann" if k < 30 else "Bob", k, x) for k, x in enumerate(v)] + [("Cid", 50, [1.0, 2.0]), ("Cid", 51, None)]
    asked = [(k, name, v[k % 20]) for k in range(40) for name in ("Ann", "Bob")] + [(90, "Cid", v[0]), (91, "Cid", [3.0, 1.0]), (92, "Dan", v[0]), (93, "Bob", None)]
    got = {(x.query_id, x["name"]): x.score for x in V.topk_scores(spark.createDataFrame(asked, "query_id long, name string, q array<double>"), spark.createDataFrame(rows, "name string, sample_no long, v array<double>")).collect()}
    for k, name, q in asked[:80]:
        assert abs(got.pop((k, name)) - np.mean(sorted((np.dot(q, x) for n, _, x in rows if n == name), reverse=True)[:3])) < 1e-9
    assert got == {(90, "Cid"): None, (91, "Cid"): 5.0, (93, "Bob"): None}


def test_best_places_take_the_earlier_of_equals():
    scores = np.array([[1.0, 3.0, 3.0, 3.0, np.nan], [np.nan, 2.0, -np.inf, 5.0, 2.0]])
    row, at = V.best_places(scores, 2)
    assert list(zip(row.tolist(), at.tolist())) == [(0, 1), (0, 2), (1, 3), (1, 1)]


@pytest.mark.parametrize("block", [5, 10_000])
def test_admission_against_all_pairs(spark, monkeypatch, block):
    """Candidates may be among the samples; those of a session of their own don't count, nor those of none."""
    from timeweave.operators.voices import admitted

    monkeypatch.setattr(V, "TOPK_BLOCK", block)
    r = np.random.default_rng(3)
    v = unit(*r.normal(size=(70, 3)))
    rows = [(("Ann", "Bob", "Cid")[k % 3 if k < 60 else 2 * (k % 2)], k, (k % 4 if k % 11 else None), x.tolist()) for k, x in enumerate(v)]
    samples = spark.createDataFrame(rows, "name string, sample_no long, session int, v array<double>")
    got = {x.query_id: x for x in admitted(samples.select(samples.sample_no.alias("query_id"), "name", "session", samples.v.alias("q")), samples.where("sample_no >= 5"), 0.9, 14).collect()}
    best = lambda q, rs: float(np.mean(sorted((np.dot(q, x[3]) for x in rs), reverse=True)[:3]))
    for name, k, session, q in rows:
        mine = [x for x in rows[5:] if x[0] == name and session is not None and x[2] is not None and x[2] != session]
        others = [best(q, o) for n in ("Ann", "Bob", "Cid") if n != name and len(o := [x for x in rows[5:] if x[0] == n]) >= 14]
        own, rival = best(q, mine) if len(mine) >= 14 else None, max(others)
        assert (got[k].own_score is None) == (own is None) and (own is None or abs(got[k].own_score - own) < 1e-9) and abs(got[k].rival_score - rival) < 1e-9
        assert got[k].admitted == (own is None or rival < 0.9 or rival < own + 0.05)
    assert len(got) == 70 and len({x.own_score is None for x in got.values()}) == 2 and len({x.admitted for x in got.values()}) == 2


def test_learned_lines_hear_the_samples_of_their_name(spark):
    lines = spark.createDataFrame([(1, "mic", k, 10_000 * k, 10_000 * k + 3000, k != 3, None, "Ann" if k < 4 else "Bob") for k in range(5)], "session_id long, source string, line_id long, start_ms long, end_ms long, locked boolean, group_id long, speaker string")
    a, b = [1.0, 0.0], [0.0, 1.0]
    chunks = spark.createDataFrame([(1, "mic", k, 10_000 * k, 10_000 * k + 2000, v) for k, v in enumerate([a, b, a, a, a])], "session_id long, source string, seg_id long, start_ms long, end_ms long, v array<double>")
    cuts = spark.createDataFrame([(1, "mic", 20_500, 20_600)], "session_id long, source string, start_ms long, end_ms long")
    samples = spark.createDataFrame([("Ann", 1, [0.9999, 0.001]), ("Bob", 2, b)], "name string, sample_no long, v array<double>")
    assert [x.line_id for x in N.learned_lines(lines, chunks, cuts, samples).collect()] == [0]
