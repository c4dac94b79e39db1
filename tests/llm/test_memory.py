import numpy as np
import pandas as pd

from tests.llm.helpers import docs
from timeweave.llm import common, ctw, jaccard_join, language_id, packing, secret_scan

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_small_batches_bound_what_a_worker_gets(spark):
    before = spark.conf.get(LIMIT)
    rows = docs(spark, [(i, "x" * 300_000) for i in range(120)]).repartition(1)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    with common.small_batches(spark):
        sizes = [r["n"] for r in rows.mapInPandas(common.giving_back(run), "n long").collect()]
    assert sum(sizes) == 120 * 300_000
    assert max(sizes) <= common.BATCH_BYTES + 300_000
    assert spark.conf.get(LIMIT) == before


def limits_of(spark, monkeypatch, module, run):
    """The limit of a batch whenever ``module`` writes a table."""
    seen = []

    def materialize(df, label):
        seen.append((label, spark.conf.get(LIMIT)))
        return common.materialize(df, label)

    monkeypatch.setattr(module, "materialize", materialize)
    run().collect()
    return dict(seen)


def test_context_trees_write_all_in_small_batches(spark, monkeypatch):
    table = docs(spark, [(i, f"some words {i} again") for i in range(30)])
    seen = limits_of(spark, monkeypatch, ctw, lambda: ctw.score_documents(table))
    assert {"chunks", "table", "scored", "scores"} <= seen.keys()
    assert set(seen.values()) == {str(common.BATCH_BYTES)}


def test_a_parts_counts_are_added_up_as_they_come(monkeypatch):
    monkeypatch.setattr(ctw, "HELD_KEYS", 100)
    longest, whole = [], ctw._summed

    def summed(key, count):
        longest.append(len(key))
        return whole(key, count)

    monkeypatch.setattr(ctw, "_summed", summed)
    key = np.arange(90, dtype=np.uint64) * np.uint64(3)
    blobs = [ctw._pack(key + np.uint64(i % 2), np.full(90, i, dtype=np.int64)) for i in range(60)]
    got, counts = ctw._added(iter(blobs))
    assert max(longest) <= 600
    assert got.tolist() == sorted([3 * k for k in range(90)] + [3 * k + 1 for k in range(90)])
    assert counts[::2].tolist() == [sum(range(0, 60, 2))] * 90 and counts[1::2].tolist() == [sum(range(1, 60, 2))] * 90


def near_copies():
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(words[: 60 - i % 3] + [f"own{i // 12}"])) for i in range(48)]


def test_near_copies_meet_in_small_batches(spark, monkeypatch):
    table = docs(spark, near_copies())
    seen = limits_of(spark, monkeypatch, jaccard_join, lambda: jaccard_join.jaccard_components(table))
    assert {"sets", "classes", "linked"} <= seen.keys()
    seen |= limits_of(spark, monkeypatch, jaccard_join, lambda: jaccard_join.keep_one_of_each(table))
    assert set(seen.values()) == {str(common.BATCH_BYTES)}


def test_index_lists_do_not_depend_on_what_is_packed_together(spark, monkeypatch):
    texts = docs(spark, near_copies()).select("doc_id", "text")
    none = np.zeros((2, 0), dtype=np.uint64)
    found = lambda: sorted(map(tuple, jaccard_join.index_lists(texts, none).collect()))
    whole = found()
    monkeypatch.setattr(jaccard_join, "HELD_ENTRIES", 20)
    assert whole and found() == whole


def test_pairs_are_added_up_in_place():
    draw = np.random.default_rng(3)
    parts = []
    for n in (0, 50, 400):
        part = np.zeros(n, dtype=jaccard_join._PAIR)
        for c, most in zip(jaccard_join._PAIR.names, (9, 9, 5, 40)):
            part[c] = draw.integers(0, most, n)
        parts.append(part)
    expected = pd.concat([pd.DataFrame(p) for p in parts]).groupby(["a", "b"], as_index=False).agg(shared=("shared", "sum"), least=("least", "min"))
    got = jaccard_join.added_pairs(parts)
    assert pd.DataFrame(got).to_numpy().tolist() == expected.to_numpy().tolist()
    assert not parts and len(jaccard_join.added_pairs([got[:0]])) == 0
    assert [len(f) for f in jaccard_join._in_frames(got, 30)] == [30] * (len(got) // 30) + [len(got) % 30] * (len(got) % 30 > 0)


def test_workers_of_the_pipeline_give_memory_back(spark, monkeypatch):
    import public_tokenizers

    kind, tasks = type(spark.range(0)), []
    plain = kind.mapInPandas

    def noted(self, function, *args, **kwargs):
        tasks.append(function)
        return plain(self, function, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInPandas", noted)
    table = docs(spark, [(i, f"plain words of row {i}", "en") for i in range(20)])
    language_id.keep_identified(table)
    secret_scan.redact(table)
    packing.best_fit_packing(table, public_tokenizers.path("word_bpe_49k.json"))
    assert len(tasks) >= 4
    assert [f for f in tasks if not hasattr(f, "__wrapped__")] == []
