import random

import pytest

from tests.llm.helpers import collected, docs
from timeweave.llm import language_id as module
from timeweave.llm.common import id_crc
from timeweave.llm.language_id import Parser, SuffixAutomaton, keep_identified, language_id, learn, normal_text, training_rows


def brute_phrases(sample, text):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        sample = "".join(r.choice("abc ") for _ in range(r.randint(0, 40)))
        text = "".join(r.choice("abcd ") for _ in range(r.randint(0, 30)))
        assert SuffixAutomaton(sample).phrases(text) == brute_phrases(sample, text)


def test_held_out_accuracy_and_kept_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = learn(training_rows(df))
    got = collected(language_id(df, samples))
    held = {r.doc_id: r.lang for r in df.where(id_crc(df.doc_id) % 4 == 2).collect()}
    right = sum(got[d].lang_pred == lang for d, lang in held.items())
    assert right >= 0.98 * len(held)
    assert keep_identified(df).count() == df.count()


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 $$$ 45", "fr"), (4, "the cat sat on the mat " * 4000, "en"), (5, "le chat est sur la table", "fr"), (6, "the mat", None), (7, "жжж щщщ ыы", None), (8, "the mat", None)]
    samples = {"en": " the cat sat on the mat ", "fr": " le chat est sur la table "}
    got = collected(language_id(docs(spark, rows), samples))
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6, 8)] == ["und", "und", "und", "en", "fr", "en", "en"]
    assert got[6].score == got[8].score and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.lang_pred == "und" for r in language_id(docs(spark, rows), {}).collect())
    assert language_id(docs(spark, []), samples).count() == 0
    train = [(i, "the cat sat on the mat and more", "en") for i in range(20)] + [(i, "le chat est sur la table", "fr") for i in range(20, 40)]
    kept = keep_identified(docs(spark, [*train, (100, "123", "en"), (101, None, None), (102, "жжж щщщ ыы", "en")]))
    assert {r.doc_id for r in kept.collect()} == set(range(40)) and "score" in kept.columns


def brute_prediction(samples, text):
    """(language, score) by the brute-force parse of the whole text."""
    whole = normal_text(text or "")
    letters = sum(c != " " for c in whole)
    if not letters:
        return "und", 0.0
    rates = {lang: brute_phrases(sample, whole) / letters for lang, sample in samples.items()}
    best = min(sorted(rates), key=rates.get)
    return best, 1 / sum((rates[best] / x) ** module.SHARPNESS for x in rates.values())


@pytest.mark.parametrize("lanes, chars", [(12, 4_000_000), (1, 50), (10**9, 300)])
def test_predictions_against_brute_force(spark, monkeypatch, lanes, chars):
    """Whole texts over blanks, in lanes, one by one and in parts of any size."""
    r = random.Random(8)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
    say = lambda letters, n: "".join(word(letters) + r.choice([" ", ", ", "  ", "\n", " 7 ", "-"]) for _ in range(n))
    samples = {lang: normal_text(say(letters, 60)) for lang, letters in (("x", "abcde"), ("y", "cdefé"), ("z", "abxyz"))}
    texts = [say(r.choice(["abcde", "cdefé", "abxyz", "abcdefÉxyzq"]), r.choice([0, 1, 2, 5, 40, 150])) for _ in range(60)]
    rows = list(enumerate([*texts, None, "", "²½① 5² ٣", "İŞ ǅ ß", "١ a²b"]))
    monkeypatch.setattr(module, "LEAST_LANES", lanes)
    monkeypatch.setattr(module, "BATCH_CHARS", chars)
    got = Parser(samples).in_parts([t or "" for _, t in rows])
    for (_, t), letters, words, phrases in zip(rows, *got):
        whole = normal_text(t or "")
        assert (letters, words) == (sum(c != " " for c in whole), len(whole.split()))
        if letters:
            assert phrases.tolist() == [brute_phrases(samples[lang], whole) for lang in sorted(samples)]
    if lanes == 12:
        found = collected(language_id(docs(spark, rows), samples))
        for d, t in rows:
            lang, score = brute_prediction(samples, t)
            assert found[d].lang_pred == lang and abs(found[d].score - score) < 1e-12


def test_sample_has_whole_texts_only(spark):
    rows = [(1, "a " * 4000, "en"), (2, "whole text, stays", "en"), (3, "x" * 6000, "en"), (4, None, "en"), (5, "123", "fr")]
    samples = learn(docs(spark, rows))
    assert set(samples) == {"en"} and sorted(samples["en"].split()) == sorted(["whole", "text", "stays", "x" * 6000])
