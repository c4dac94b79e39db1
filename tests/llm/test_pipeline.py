"""The pipeline against plain recomputation, and its stages on rows with clashing columns."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_jaccard_join import brute
from tests.llm.test_language_id import brute_phrases
from timeweave.llm import language_id

corpus_pipeline = pytest.importorskip("corpus_pipeline")
CLASHES = ("_kept_id", "_salt", "_doc", "_spans", "_text", "rep", "component_id", "keep_id", "kept", "excess", "letters", "length", "row", "cuts", "text_hash", "id", "labelled", "spans", "n_live")


def fixture():
    r = random.Random(11)
    words = {"en": ["the", "cat", "sat", "mat", "dog", "ran", "house", "river", "stone", "light"], "fr": ["le", "chat", "est", "sur", "table", "avec", "maison", "pierre", "eau", "nuit"]}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        rows.append([i, say(lang, r.choice([20, 30, 60, 5000 if i == 7 else 40])), lang, f"s{i % 5}"])
    for i in range(0, 20):
        rows.append([200 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2], "copy"])
    for i in range(20, 40):
        rows.append([300 + i, rows[i][1] + " end", None, "near"])
    key = "AKIA" + "K" * 16
    rows += [[400, say("en", 12) + f" token = abcdefgh12345 {key}", "en", "me"], [401, say("en", 15) + f" {key} x", "en", "me"], [402, say("en", 9) + " password: qwertyuiop", "en", "a"], [403, say("fr", 14) + " password: qwertyuiop", "fr", "b"]]
    rows += [[500, None, "en", "s"], [501, "", None, None], [502, "12 34 !!", "fr", "s"], [503, "xqz wvk jjq zzx qqk vvx", None, "s"], [504, "жжж щщщ ыы", None, None]]
    return [(d, t, lang, source, len(t or "")) for d, t, lang, source in rows]


def spread(values):
    """(median, 95th percentile) as Spark's exact ranks give them."""
    s = sorted(values)
    return tuple(s[max(0, int(np.ceil(q * len(s))) - 1)] for q in (0.5, 0.95))


def identified(spark, rows):
    """Ids that the first stage keeps: phrases counted one by one over the words without digits."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    samples = language_id.learn(language_id.training_rows(docs))
    judged = []
    for d, t, lang, *_ in rows:
        prose = language_id.normal_text(" ".join(w for w in (t or "").lower().split() if not any(c in "0123456789" for c in w)))
        whole = prose or language_id.normal_text(t or "")
        letters, n = sum(unicodedata.category(c)[0] == "L" for c in whole), sum(c != " " for c in prose)
        excess = (min(brute_phrases(s, whole) for s in samples.values()) - len(whole.split())) / letters if letters else 0.0
        judged.append((d, zlib.crc32(str(d).encode()) % 4 != 2 and lang is not None, letters, n.bit_length(), excess))
    labelled = [x for x in judged if x[1] and x[3]]
    limit = lambda xs: max(0.0, (m := spread([x[4] for x in xs]))[0] + 4 * (m[1] - m[0]))
    own = {k: limit(group) for k in {x[3] for x in labelled} if len(group := [x for x in labelled if x[3] == k]) >= 30}
    most = max([limit(labelled), *own.values()])
    return {d for d, _, letters, k, excess in judged if letters and excess <= own.get(k, most)}


def test_run_against_recomputation(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [x for x in rows if x[0] in identified(spark, rows)]
    assert {500, 501, 502, 503, 504} & {x[0] for x in kept} == set() and {x[0] for x in rows if x[0] < 500} == {x[0] for x in kept}
    last = {x[1].lower(): x[0] for x in sorted(kept)}
    kept = [x for x in kept if last[x[1].lower()] == x[0]]
    components = brute([(d, t) for d, t, *_ in kept])
    kept = [x for x in kept if components[x[0]][1] == x[0]]
    assert len(kept) < 130
    owners = {}
    key, token, shared = "AKIA" + "K" * 16, "token = abcdefgh12345", "password: qwertyuiop"
    for d, t, _, source, _ in kept:
        for secret in (key, token, shared):
            if secret in t:
                owners.setdefault(secret, set()).add(source)
    texts = {}
    for d, t, *_ in kept:
        for secret, who in owners.items():
            t = t.replace(secret, "[SECRET]") if len(who) == 1 else t
        texts[d] = t
    assert sum("[SECRET]" in t for t in texts.values()) == 2 and sum(shared in t for t in texts.values()) == 2
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want |= {(d, k, a, len(x := ids[a : a + 4096]), zlib.crc32(x.tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 4096) + 1


def test_stages_with_clashing_columns(spark):
    rows = [x for x in fixture() if x[0] % 3 == 0 or x[0] >= 400] + [(None, "no id at all", "en", "s", 12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema == docs.schema, name
        got = {r.doc_id: r for r in out.collect()}
        assert all(r[c] == (None if d is None else f"{c} of {d}") for d, r in got.items() for c in CLASHES), name
        assert {(d, r.text) for d, r in got.items()} == {(r.doc_id, r.text) for r in stage(spark, plain, "").collect()}, name
