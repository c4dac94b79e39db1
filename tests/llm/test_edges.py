"""Nulls in every column, repeated rows and clashing columns, through every operator on documents and the pipeline."""

import public_tokenizers
import pytest

from timeweave.llm import bpe, ctw, exact_dedup, jaccard_join, language_id, packing, secret_scan, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, a string, part int, chunk int, word string"
ROWS = [
    (2**60, "The cat sat on the mat and then the cat left again", "en", "s1", 50, 1, "x", 1, 1, "w"),
    (None, "The cat sat on the mat and then the cat left again", "en", "s1", 50, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, None),
    (4, "", "", "", 0, 0, "", 0, 0, ""),
    (5, "the cat sat on the mat and then the cat left again", None, None, None, 1, "x", 1, 1, "w"),
    (5, "the cat sat on the mat and then the cat left again", None, None, None, 1, "x", 1, 1, "w"),
    (-7, "token = abcdefgh12345 le chat est sur la table", "fr", None, 3, 1, "x", 1, 1, "w"),
]
IDS = sorted(r[0] for r in ROWS if r[0] is not None)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_every_row_with_an_id_comes_back(spark, frame):
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(5, 1, 1, "x"), (None, None, None, None), (2**60, 0, 0, "x"), (5, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    results = {
        "packing": packing.best_fit_packing(frame, word), "bpe": bpe.encode(frame, byte, public_tokenizers.PATTERN),
        "language": language_id.language_id(frame, language_id.learn(frame)), "toxicity": toxicity.score_documents(frame, toxicity.learn(frame, labels)),
        "ctw": ctw.score_documents(frame), "jaccard": jaccard_join.jaccard_components(frame), "secrets": secret_scan.secret_scan(frame), "exact": exact_dedup.exact_dedup(frame),
    }
    for name, df in results.items():
        assert sorted(r.doc_id for r in df.collect()) == IDS, name


def test_pipeline_stages(spark, frame):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    kept = corpus_pipeline.identify_language(spark, docs, "")
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, kept, ""), "")
    assert {r.doc_id for r in kept.collect()} == {2**60, -7}
    packed = corpus_pipeline.pack(spark, corpus_pipeline.redact_secrets(spark, kept, ""), "")
    assert {r.doc_id for r in packed.collect()} == {2**60, -7}
