import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import docs, table
from timeweave.llm.packing import WordEncoder, best_fit_packing, lower_bound, plan, reduce_by_dominance

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = set()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want |= {(doc_id, k, a, len(x := ids[a : a + capacity]), zlib.crc32(x.tobytes())) for k, a in enumerate(range(0, len(ids), capacity))}
    got = df.collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(r.length for r in got)


def test_real_documents(spark):
    frame = table("documents")
    n, tokens = check(best_fit_packing(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH), list(zip(frame.doc_id, frame.text)), 4096)
    assert n <= -(-tokens // 4096) + 1


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b\x85c d ' 's don't ́x é 12 $$$***"), (4, "word " * 30_000), (5, "<|endoftext|> İ ΑΣ ß\x1c\x1d"), (6, "a"), (7, "a"), (8, "　\n\t")]
    check(best_fit_packing(docs(spark, rows), PATH, capacity=64), rows, 64)
    assert best_fit_packing(docs(spark, []), PATH).count() == 0


def optimum(items, capacity):
    """Fewest bins by trying all placements."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, (*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]))
        go(i + 1, (*rooms, capacity - items[i]))

    go(0, ())
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(items):
    counts = {x: items.count(x) for x in items}
    fixed, left = reduce_by_dominance(counts, 20)
    rest = [x for x, n in left.items() for _ in range(n)]
    best = optimum(items, 20)
    assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == best
    assert lower_bound(counts, 20) <= best <= plan(counts, 20)[1]["sequences"]


def test_sets_of_three_are_fixed():
    # 6 leaves 14: 9 and 5 fill it, and no two items longer than 5 fit there.
    fixed, left = reduce_by_dominance({9: 2, 6: 2, 5: 3}, 20)
    assert ((6, 9, 5), 2) in fixed and sum(n * sum(lengths) for lengths, n in fixed) + sum(x * n for x, n in left.items()) == 45
    assert lower_bound({9: 2, 6: 2, 5: 3}, 20) == 3 and lower_bound({}, 20) == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=20))
def test_plan_places_every_piece_once(counts):
    segments, figures = plan(counts, 40)
    used = {}
    for k, (length, start, times, sequence, offset) in enumerate(segments):
        same = [s for s in segments if s[0] == length]
        at = [s[1] for s in same].index(start)
        end = same[at + 1][1] if at + 1 < len(same) else counts[length]
        for rank in range(start, end):
            nth = rank - start
            used.setdefault(sequence + nth // times, []).append((offset + nth % times * length, length))
    assert sum(map(len, used.values())) == sum(counts.values()) and len(used) == figures["sequences"]
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 40


def test_ids_of_odd_words():
    """Random Unicode against the tokenizer: marks, cases and punctuation after any letter."""
    tokenizer, encoder, r = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(6)
    parts = ["İ", "I", "ı", "ß", "Σ", "ς", "é", "e\u0301", "\u0307", "ﬁ", "ǆ", "ა", "Ა", "\u1c89", "字", "ꟑ", "²", "½", "٣", "'s", "'", "don't", "a", "B", "zebra", *WordEncoder.TAIL.decode(), "_", "\xa0", " ", "\n", "\x85", "<|", "|>", "\x00", "😀"]
    texts = ["İ$", "istanbul İ, İ. x", *["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(6000)]]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(32, 0xD800), r.randrange(0x10000, 0x20000)])) + r.choice(["", "", "$", ". "]) for _ in range(8)) for _ in range(3000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == want.ids, text
