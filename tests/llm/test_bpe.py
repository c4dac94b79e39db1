import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.helpers import SF, collected, docs, table
from timeweave.llm.bpe import encode, heap_merges, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def check(got, texts, library):
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        row = got[doc_id]
        assert row.n_tokens == len(ids), (doc_id, text and text[:60])
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_real_documents(spark, library):
    frame = table("documents")
    got = collected(encode(spark.read.parquet(f"{SF}/documents.parquet"), PATH, public_tokenizers.PATTERN))
    check(got, list(zip(frame.doc_id, frame.text)), library)


def test_edge_cases(spark, library):
    r = random.Random(5)
    texts = [None, "", " ", "  \n\n\t x", "a", "I'll don't we've 'S", "é" * 500, "日本語 テキスト ①②", "\x1c\x1d\x85\xa0 x y", "👩‍👩‍👧 🇩🇪", "a" * 3000, "ab" * 40_000, "=" * 5000 + "\n" * 5000, "<|endoftext|>"]
    texts += ["".join(r.choice("abcdeé ñ.,'\n0123456789$%ASDthing") for _ in range(300)) for _ in range(20)]
    rows = list(enumerate(texts))
    check(collected(encode(docs(spark, rows), PATH, public_tokenizers.PATTERN)), rows, library)
    assert encode(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    assert encode(docs(spark, rows[:5] * 3), PATH, public_tokenizers.PATTERN).count() == 15


def test_heap_merges(library):
    r, ranks = random.Random(9), load_ranks(PATH)
    for _ in range(100):
        word = "".join(r.choice("abcdethin gstr") for _ in range(r.randint(1, 300))).replace(" ", "")
        if word:
            assert heap_merges(word.encode(), ranks) == library.encode_ordinary(word)
