import math
import zlib
from collections import Counter
from functools import cache

import numpy as np

from tests.llm.helpers import collected, docs
from timeweave.llm import ctw


def log_kt(a, b):
    total = 0.0
    for i in range(a):
        total += math.log((i + 0.5) / (i + 1))
    for j in range(b):
        total += math.log((j + 0.5) / (a + j + 1))
    return total


def test_block_probability():
    for a, b in ((0, 0), (1, 0), (0, 5), (7, 3), (40, 60)):
        assert abs(ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0] - log_kt(a, b)) < 1e-9


def brute_model(counts):
    """log10 P(byte | context) by plain recursion over dictionaries; counts by (DEPTH context bytes, newest first; byte)."""

    def node(context, bits):
        got = [0, 0]
        for (c, byte), n in counts.items():
            text = f"{byte:08b}"
            if c[: len(context)] == context and text.startswith(bits):
                got[int(text[len(bits)])] += n
        return got

    @cache
    def mixed(context, bits):
        own = log_kt(*node(context, bits))
        if len(context) == ctw.DEPTH:
            return own
        below = sum(mixed(c, bits) for c in {c[: len(context) + 1] for c, _ in counts if c[: len(context)] == context})
        return float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + below))

    @cache
    def predict(context, bits, bit, depth=0):
        at = context[:depth]
        n = node(at, bits)
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if depth == ctw.DEPTH:
            return own
        w = math.exp(math.log(0.5) + log_kt(*n) - mixed(at, bits))
        return w * own + (1 - w) * predict(context, bits, bit, depth + 1)

    def log_p(context, byte):
        text = f"{byte:08b}"
        return sum(math.log10(predict(context, text[:k], int(text[k]))) for k in range(8))

    return log_p


def normal(text):
    return b" ".join([*(text or "").encode().lower().split(), b"\n"])


def pairs(text):
    """(context, newest byte first; byte) of every byte of a normalised text, end marks before it."""
    padded = b"\n" * ctw.DEPTH + text
    return [(tuple(padded[i - ctw.DEPTH : i][::-1]), padded[i]) for i in range(ctw.DEPTH, len(padded))]


def test_keys_against_slices():
    texts = [b"\n", b"ab cd \n", b"x" * 40 + b" \n", b"\n"]
    keys = ctw.pair_keys(texts).tolist()
    want = [sum(b << 8 * (i + 1) for i, b in enumerate(c)) | byte for t in texts for c, byte in pairs(t)]
    assert keys == want


def test_scores_against_recursion(spark):
    """The end-to-end score of every document, over blanks and unseen bytes, is that of the plain recursion over the training documents."""
    rows = [(i, ["a b", "ab a ba", "b", "ab ab b a", "", None, "A  ab"][i % 7]) for i in range(20)] + [(30, "ab zé b"), (31, "q")]
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(pairs(normal(t)))
    log_p, got = brute_model(counts), collected(ctw.score_documents(docs(spark, rows)))
    assert any(r.held_out for r in got.values())
    for d, t in rows:
        want = sum(log_p(*x) for x in pairs(normal(t)))
        assert abs(got[d].score - want) < 1e-8 * abs(want)
        assert abs(got[d].bits_per_byte + want / math.log10(2) / len(normal(t))) < 1e-8


def test_probabilities_of_all_bytes_add_up():
    texts = [b"ab ba \n", b"aab \n", b"abcab cab \n"] * 3
    key, count = ctw._summed(ctw.pair_keys(texts), np.ones(sum(map(len, texts))))
    lower = ctw.lower_levels(key, count)
    short, n = ctw._summed(key & np.uint64(0xFFFF), count)
    nodes, up = np.unique(lower[0].parents(1), return_inverse=True)
    upper = ctw.upper_levels(short, n, nodes, np.bincount(up, weights=lower[0].mixed))
    for context in {*(key >> np.uint64(8)).tolist(), 0x616161, 7}:
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** ctw.log_probabilities(every, upper, lower)).sum() - 1) < 1e-9


def test_documents_base_and_blocks_of_any_size(spark, monkeypatch):
    rows = [(i, f"the cat {i % 7} sat on the mat and then some more words{i % 11}") for i in range(60)] + [(100, None), (101, ""), (102, "é ñ \x0bA \x00 b"), (103, "x" * 50_000), (104, "unseen zebra " * 3000)]
    df = docs(spark, rows)
    got = collected(ctw.score_documents(df))
    monkeypatch.setattr(ctw, "PIECE_BYTES", 40)
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 300)
    monkeypatch.setattr(ctw, "GROUP", 3)
    small = collected(ctw.score_documents(df))
    train, tokens = Counter(), {}
    for d, t in rows:
        tokens[d] = (t or "").encode().lower().split() + [b"\n"]
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(tokens[d])
    n, v = sum(train.values()), len(train)
    for d, w in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * abs(r.base_score)
        assert r.score < 0 and abs(r.score - small[d].score) < 1e-9 * abs(r.score)
    assert ctw.score_documents(docs(spark, [])).count() == 0
    untrained = collected(ctw.score_documents(docs(spark, [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "ab")])))
    assert all(abs(r.bits_per_byte - 8) < 1e-9 and r.train_tokens == 0 for r in untrained.values())


def test_documents_travel_in_pieces(spark):
    rows = spark.createDataFrame([(d, f"w{d} " * 100_000, False) for d in range(12)], "id long, text string, held_out boolean").coalesce(1)
    found = ctw.count_chunks(rows, 4).where(f"kind = {ctw.DOCUMENTS}").select("chunk", "part").collect()
    assert len({r.chunk for r in found}) == 1 and len({r.part for r in found}) == len(found) >= 3


def test_a_tally_holds_little_more_than_its_distinct_keys():
    tally, r, most = ctw.Tally(), np.random.default_rng(1), 0
    for _ in range(20):
        key = r.integers(0, 1_000_000, 500_000).astype(np.uint64)
        tally.add(key, np.ones(len(key)))
        most = max(most, tally.held)
    assert most < 3_000_000
    assert sum(int(c.sum()) for c in tally.counts) == 10_000_000
