import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import collected, docs
from timeweave.llm import jaccard_join
from timeweave.llm.components import connected_components
from timeweave.llm.jaccard_join import jaccard_components, keep_one_of_each, list_pairs, member_links, prefixes, shingle_sets


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def families(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    out = []
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([3, 4, 5, 8, 30, 60, 120]))]
        if r.random() < 0.3:
            base = passage + base
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w) + r.choice(["", " ", "\n"]))
    order = list(range(len(out)))
    r.shuffle(order)
    return list(zip(order, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_families_against_brute_force(spark, seed):
    rows = families(seed)
    got = collected(jaccard_components(docs(spark, rows)))
    want = brute(rows)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (2, "A b"), (9, "a B"), (8, "a b c d e"), (7, "A B C D E"), (1, "x " * 30_000), (10, "x " * 20_000), (11, "é É ß x\x0by")]
    df = docs(spark, rows + rows[:4])
    got = jaccard_components(df).collect()
    assert len(got) == len(rows) + 4
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    kept = keep_one_of_each(docs(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute(rows).values()} and "score" in kept.columns
    assert jaccard_components(docs(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000))
def test_lists_bring_every_link_together(seed):
    """The count of shared lists never falls below what a linking pair is asked for."""
    r = random.Random(seed)
    n = r.randint(1, 120)
    a = set(range(n))
    b = set(a)
    for _ in range(r.randint(0, max(1, n // 6))):
        if r.random() < 0.5 and len(b) > 1:
            b.remove(r.choice(sorted(b)))
        else:
            b.add(r.randint(1000, 2000))
    if 100 * len(a & b) < 80 * len(a | b):
        return
    h = {x: r.getrandbits(60) for x in a | b}
    often = np.array(sorted(r.sample(sorted(h.values()), len(h) // 3)), dtype=np.uint64)
    frequent = np.stack([often, np.arange(len(often), dtype=np.uint64)])
    parts = prefixes([np.array(sorted(h[x] for x in s), dtype=np.uint64) for s in (a, b)], frequent)
    shared, least = 0, None
    for x in set(parts[0].tolist()) & set(parts[1].tolist()):
        places = np.array([p.tolist().index(x) for p in parts])
        sizes = np.array([len(a), len(b)])
        order = np.argsort(sizes, kind="stable")
        found = list_pairs(np.zeros(2, dtype=np.int64), np.array([1, 2])[order], np.array([1, 2])[order], sizes[order], places[order])
        if len(found[0]):
            shared, least = shared + 1, int(found[2][0])
    assert least is not None and shared >= least


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(1000, k) for k in range(1001, 1100)]
    parent = defaultdict(lambda: None)

    def find(x):
        parent[x] = x if parent[x] is None else parent[x]
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


def test_short_texts_and_hashes(monkeypatch):
    one = lambda text: next(shingle_sets([text]))
    assert len(one("")) == 0 and len(one("a b")) == 1 and len(one("a b c d e f")) == 2
    assert (one("a b") == one("A  b\n")).all() and (one("b a") != one("a b")).all()
    texts = ["", "a b c d", "a b c d e f g", "", "x " * 100, "q", "a b c d e f g"]
    whole = [x.tolist() for x in shingle_sets(texts)]
    monkeypatch.setattr(jaccard_join, "SHINGLE_BYTES", 1)
    assert whole == [x.tolist() for x in shingle_sets(texts)] == [one(t).tolist() for t in texts]
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts]


def test_pairs_of_a_list_against_all_pairs(monkeypatch):
    r = np.random.default_rng(5)
    lists, sizes = np.sort(r.integers(0, 9, 200)), r.integers(1, 40, 200)
    order = np.lexsort((sizes, lists))
    lists, sizes = lists[order], sizes[order]
    stars, groups, places = r.integers(0, 30, 200), r.integers(0, 3, 200), np.minimum(r.integers(0, 8, 200), sizes - 1)
    want = {}
    for i in range(200):
        for j in range(200):
            if lists[i] == lists[j] and groups[i] != groups[j] and sizes[i] <= sizes[j] and 4 * sizes[j] <= 5 * sizes[i]:
                least = int(jaccard_join.least_shared(sizes[i], sizes[j]))
                if min(sizes[i] - places[i], sizes[j] - places[j]) + least - 1 >= (4 * (sizes[i] + sizes[j]) + 8) // 9:
                    key = (int(lists[i]), *sorted((int(stars[i]), int(stars[j]))))
                    want[key] = min(want.get(key, least), least)
    a, b, least = list_pairs(lists, stars, groups, sizes, places)
    assert sorted(zip(a.tolist(), b.tolist(), least.tolist())) == sorted((k[1], k[2], v) for k, v in want.items())


@pytest.mark.parametrize("block", [400, 3])
def test_members_of_open_stars_against_all_pairs(spark, monkeypatch, block):
    """Hosts and guests in blocks find every pair of stars whose members link."""
    monkeypatch.setattr(jaccard_join, "STAR_BLOCK", block)
    words = [f"w{i}" for i in range(100)]
    ends = lambda base, step: [" ".join(base[: len(base) - step * k]) for k in range(8)]
    rows = list(enumerate(ends(words, 2) + ends([*words[:82], *[f"x{i}" for i in range(8)]], 1) + ends([*words[:60], *[f"z{i}" for i in range(40)]], 1)))
    sets = {d: shingles(t) for d, t in rows}
    similar = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    stars = [(d, len(sets[d]), d // 8 * 8, 1 - similar(d, d // 8 * 8)) for d in sets]
    open_pairs = [(a, b, 1 - similar(a, b)) for a, b in ((0, 8), (0, 16), (8, 16))]
    got = member_links(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(stars, "doc_id long, n long, center long, far double"), spark.createDataFrame(open_pairs, "a long, b long, d double"))
    want = {(a, b) for a, b, _ in open_pairs for x in sets for y in sets if x // 8 * 8 == a and y // 8 * 8 == b and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert want == {(0, 8)} == {tuple(sorted(r)) for r in got.collect()}
