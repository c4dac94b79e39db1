import pytest

from tests.llm.helpers import collected, docs
from tests.llm.test_jaccard_join import families, shingles
from timeweave.llm import jaccard_join
from timeweave.llm.jaccard_join import jaccard_components


def brute_links(rows):
    sets = {d: shingles(t) for d, t in rows}
    return {a: sum(bool(x) and a != b and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}


@pytest.mark.parametrize("block", [400, 5])
def test_links_of_every_document_against_brute_force(spark, monkeypatch, block):
    """Equal copies, members of a star and pairs inside a component count; small blocks deal a component to many tasks."""
    monkeypatch.setattr(jaccard_join, "STAR_BLOCK", block)
    rows = families(3, 80)
    base = [f"v{i}" for i in range(60)]
    near = [" ".join(base[:-k] if k else base) for k in range(14)] + [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 60, 7)]
    texts = near + [near[0]] * 6 + [near[20].upper()] * 3 + ["short one"] * 4 + [None, ""]
    rows += list(enumerate(texts, 1000))
    got = collected(jaccard_components(docs(spark, rows + rows[:5])))
    want = brute_links(rows)
    assert max(want.values()) > 10
    assert {d: r.n_links for d, r in got.items()} == want
