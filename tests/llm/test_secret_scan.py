import hashlib
import math
import re

from pyspark.sql import functions as F

from tests.llm.helpers import SF, collected, docs, table
from timeweave.llm.secret_scan import OPAQUE_BITS, redact, secret_scan

KEY = "AKIA" + "Q" * 16
HEX = "0123456789abcdef" * 2


def brute(text):
    """The base definition, word for word."""
    t = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for rank, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[0]) >= least]
    out.sort()
    return [sum(x[1] == k for x in out) for k in range(3)], hashlib.sha256(",".join(x[2] for x in out).encode()).hexdigest()


CASES = [
    None, "", "password=token = abcdefgh", 'API_KEY: "abcdefgh"', "apikey='abc' passwd=12345678", f"secret={HEX}", f"é{KEY} AKIA AKIASHORT {KEY}x",
    "toKen=abcdefgh ſecret=abcdefgh", f"x{HEX}{HEX}y {HEX[:31]}", "x" * 100_000 + f" token:{HEX} " + "y" * 100_000, "Token = \"a.b/c+d=e-f_g\"", "password:=abcdefgh",
]


def test_base_spans_against_brute_force(spark):
    got = collected(secret_scan(docs(spark, list(enumerate(CASES)))))
    assert len(got) == len(CASES)
    for k, text in enumerate(CASES):
        counts, digest = brute(text)
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == counts, text
        assert got[k].base_sha256 == digest


def test_real_documents(spark):
    frame = table("documents")
    got = collected(secret_scan(spark.read.parquet(f"{SF}/documents.parquet")))
    for doc_id, text in zip(frame.doc_id, frame.text):
        counts, digest = brute(text)
        assert ([got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex], got[doc_id].base_sha256) == (counts, digest)


def test_ownership_and_redaction(spark):
    live, example = "AKIA" + "L" * 16, "AKIA" + "E" * 16
    rows = [(i, f"see {example} here", None, f"owner{i % 5}") for i in range(50)] + [(100, f"my {live}, token={HEX}!", None, "me"), (101, f"my {live}", None, "me"), (102, None, None, None)]
    df = docs(spark, rows + [rows[-2]])
    got = collected(secret_scan(df))
    assert (got[0].n_live, got[0].n_copied, got[101].n_live, got[100].n_copied, got[102].n_live) == (0, 1, 1, 0, 0)
    out = redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    out = collected(out)
    assert out[0].text == rows[0][1] and out[102].text is None
    assert out[101].text == "my [SECRET]" and out[101].n_chars == len("my [SECRET]")
    assert out[100].text == "my [SECRET], [SECRET]!"
    assert secret_scan(docs(spark, [])).count() == 0


def test_all_columns_against_brute_force(spark):
    """Added spans, their order, ownership counts and live spans of every document, recomputed one by one."""
    bearer, github, jwt = "Bearer " + "b1C-" * 5, "ghp_" + "aB3" * 12, "eyJhbGciOi9x.eyJzdWIiOi9x.c2lnbmF0dXJl"
    opaque = ["Zm9vYmFyQ1h5ejEyMzQ1Njc4OTBhYmNkRUZH", "q7Rt2LmX9vB4nZ8cK1wY6pH3sD5fJ0gT=="]
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc123\n-----END RSA PRIVATE KEY-----"
    texts = [f"a {bearer} b", f"{github}, {opaque[0]}", f"é {jwt} {opaque[0]}", f"{pem} and {opaque[1]} token={opaque[1]}", f"{opaque[0]} {opaque[0]}", f"token = {HEX} {KEY}", f"{HEX} x" * 3, "clean text only", None, "A" * 60, "abc123" * 10]
    rows = [(i, texts[i % len(texts)], None, f"o{i % 3}" if i % len(texts) in (0, 4, 5) else f"own{i % len(texts)}") for i in range(44)]
    more = {"bearer": r"Bearer [A-Za-z0-9+/_.=-]{16,}", "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}", "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"}
    order = ["assign", "access", "hex", *more, "opaque"]

    def spans(t):
        t = t or ""
        out = [(m.start(), m.end(), "assign", m[2]) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?i:password", "((?i:password").replace("key)", "key))"), t) if len(m[2]) >= 8]
        for kind, pattern in {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", **more}.items():
            out += [(m.start(), m.end(), kind, m[0]) for m in re.finditer(pattern, t)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{28,}={0,2}", t):
            share = [m[0].count(c) / len(m[0]) for c in set(m[0])]
            mixed = re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])
            if mixed and -sum(p * math.log2(p) for p in share) >= OPAQUE_BITS and not any(a < m.end() and m.start() < b for a, b, *_ in out if _[0] != "opaque"):
                out.append((m.start(), m.end(), "opaque", m[0]))
        return sorted(out, key=lambda x: (x[0], order.index(x[2])))

    owners = {}
    for _, t, _, owner in rows:
        for *_, secret in spans(t):
            owners.setdefault(secret, set()).add(owner)
    got = collected(secret_scan(docs(spark, rows)))
    kinds = set()
    for d, t, *_ in rows:
        want = [(a, b, k, len(owners[secret]) == 1) for a, b, k, secret in spans(t)]
        want = [x for x in want if x[3] or x[2] != "opaque"]
        kinds |= {x[2] for x in want}
        assert got[d].spans == ",".join(f"{k}:{a}:{b}" for a, b, k, _ in want), t
        assert (got[d].n_live, got[d].n_copied) == (sum(x[3] for x in want), sum(not x[3] for x in want))
        assert [(s.start, s.end, s.kind) for s in got[d].live_spans or []] == [x[:3] for x in want if x[3]]
    assert kinds == set(order)


def test_redaction_of_repeated_ids_and_clashing_names(spark):
    rows = [(1, f"my key {KEY} is long enough", "me", 3, "a"), (1, "harmless text that is long enough", "me", 3, "b"), (None, f"no id {KEY}", "me", 1, "c"), (2, None, "me", 2, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, _text string")
    for name in ("_spans", "_doc", "cuts", "row", "changed", "text_hash", "found", "_salt"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    out = redact(df)
    assert out.schema["n_chars"].dataType == df.schema["n_chars"].dataType and out.columns == df.columns
    got = {r["_text"]: r for r in out.collect()}
    assert got["a"].text == "my key [SECRET] is long enough" and got["a"].n_chars == len(got["a"].text)
    assert [got[k].text for k in "bcd"] == [rows[1][1], rows[2][1], None] and got["b"].n_chars == 3
    assert all(r[c] == f"own {c}" for r in got.values() for c in df.columns[5:])
    assert redact(df.limit(0)).count() == 0
