"""Stars of long index lists meet as sets: every link is found, and pairs there are no rows."""

import random

import pytest

from tests.llm.helpers import collected, docs
from tests.llm.test_jaccard_join import brute, families
from timeweave.llm import jaccard_join
from timeweave.llm.jaccard_join import candidate_stars, jaccard_components


@pytest.mark.parametrize(("least", "block"), [(1, 7), (3, 400)])
def test_families_with_long_lists_against_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", least)
    monkeypatch.setattr(jaccard_join, "STAR_BLOCK", block)
    rows = families(3, 120)
    got = collected(jaccard_components(docs(spark, rows)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute(rows)


def test_a_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    r = random.Random(8)
    base, rows = [f"w{r.randrange(10**6)}" for _ in range(130)], []
    for d in range(300):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    counted = []

    def count(entries):
        pairs = candidate_stars(entries)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "candidate_stars", count)
    got = collected(jaccard_components(docs(spark, rows)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute(rows)
    assert counted and sum(counted) <= 300
