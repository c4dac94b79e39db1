"""Secret scan with corpus-wide ownership frequency.

Each text is scanned for credentials; the hash of each candidate is then counted
over distinct repositories and owners of the whole corpus. What many owners have
is a copied example; what one owner has looks live.

Opaque strings (long, of mixed characters, in no credential's form) are
candidates only: whether such a string is given as a span is for the ownership
counts to say, which drop those that several owners have.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import attach, giving_back, identified, materialize

#: Base kinds, in the order in which equal starts are listed, and those that the scan adds.
BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("bearer", "github", "jwt", "pem", "opaque")
KINDS = BASE_KINDS + MORE_KINDS

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_MORE = {
    "bearer": ("Bearer ", re.compile(r"Bearer [A-Za-z0-9+/_.=-]{16,}")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
}
#: An opaque string has upper and lower case, digits, so many characters, and so many bits a character.
OPAQUE_BITS = 4.0
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{28,}={0,2}")
_MIXED = re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def bits(text: str) -> float:
    """Entropy of the characters of a text, in bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def opaque_spans(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Opaque strings that meet none of the spans already found."""
    out = []
    for m in _OPAQUE.finditer(text):
        if all(p.search(m[0]) for p in _MIXED) and bits(m[0]) >= OPAQUE_BITS and not any(a < m.end() and m.start() < b for a, b, _, _ in found):
            out.append((m.start(), m.end(), "opaque", m[0]))
    return out


def find_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(kind, start, end, secret) as (start, rank of kind) sorted tuples (start, end, kind, secret).

    Offsets are code points, the end is exclusive. ``assign`` covers the whole
    match, its secret is the value.
    """
    found = []
    lower = text.lower()
    if any(word in lower for word in _WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    for kind, (hint, pattern) in _MORE.items():
        if hint in text:
            found += [(m.start(), m.end(), kind, m[0]) for m in pattern.finditer(text)]
    found += opaque_spans(text, found)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str, str]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` of the given kinds, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans if kind in kinds)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row a document with an id: its spans with the hash of each candidate, and the hash of its text; null texts are empty."""
    columns = "doc_id long, owner string, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, span_list array<struct<start:int,end:int,kind:string,secret:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, owner, text_hash, text in zip(batch["doc_id"], batch["owner"], batch["text_hash"], batch["text"]):
                spans = find_spans(text)
                counts = [sum(s[2] == kind for s in spans) for kind in BASE_KINDS]
                out.append((doc_id, owner, text_hash, *counts, hashlib.sha256(joined(spans, BASE_KINDS).encode()).hexdigest(), [{"start": a, "end": b, "kind": k, "secret": hashlib.sha256(s.encode()).hexdigest()} for a, b, k, s in spans]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return identified(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInPandas(giving_back(run), columns)


def ownership(candidates: DataFrame) -> DataFrame:
    """``candidates`` (doc_id, owner, secret, ...) with n_repositories and n_owners of the secret's hash.

    A document stands for its repository. Repeats within a repository and within
    an owner are taken out by two combining aggregations before the counts meet,
    and the counts go back by salted groups, so a secret that a third of all
    documents have loads no single task.
    """
    owners = candidates.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("_n")).groupBy("secret").agg(F.count(F.lit(1)).alias("n_owners"))
    repositories = candidates.select("secret", "doc_id").distinct().groupBy("secret").agg(F.count(F.lit(1)).alias("n_repositories"))
    return attach(candidates, owners.join(repositories, "secret"), ["secret"], "doc_id")


def judged_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, live_owners: int, live_repositories: int | None) -> DataFrame:
    """The rows of ``scan``, each with n_live, n_copied and its spans (start, end, kind, live) that ownership leaves, in order."""
    scanned = materialize(scan(docs, id_col, text_col, owner_col), "secrets")
    every = scanned.where(F.size("span_list") > 0).select("doc_id", "text_hash", "owner", F.explode("span_list").alias("s")).select("doc_id", "text_hash", "owner", "s.*")
    live = (F.col("n_owners") <= live_owners) & (F.lit(True) if live_repositories is None else F.col("n_repositories") <= live_repositories)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    judged = ownership(every.distinct()).withColumn("live", live).where("live OR kind <> 'opaque'")
    # A text's spans are the same on every row of its id.
    by_text = judged.groupBy("doc_id", "text_hash", "owner").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "live"))).alias("found")
    )
    return scanned.drop("span_list").join(by_text, ["doc_id", "text_hash", "owner"], "left")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", live_owners: int = 1, live_repositories: int | None = None) -> DataFrame:
    """One row a document: counts and digest of the base spans, all spans, and n_live, n_copied, live_spans.

    A candidate is live-looking if at most ``live_owners`` owners have it, in any
    number of documents, else copied; ``live_repositories`` bounds the documents
    as well, where given. Opaque strings are spans only where they are live.
    Null or empty texts have no spans; a null owner counts as one owner. Repeated
    rows count once a repository; rows without an id are left out. An empty table
    gives no rows; further columns aren't read.
    """
    found = judged_spans(docs, id_col, text_col, owner_col, live_owners, live_repositories)
    return found.select(
        F.col("doc_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.transform(F.filter("found", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("live_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each live-looking credential replaced by ``mark`` and ``chars_col`` counted anew where that happens.

    Rows are never dropped; copied examples stay as they are, as do null and empty
    texts and rows without an id. A row is cut by the spans of its own text, so
    rows that repeat an id with other texts keep theirs whole. Overlapping spans
    share a mark. Opaque strings, which have no credential's form, stay. Columns that aren't named here may have any names and stay; an
    empty table gives no rows.
    """
    found = judged_spans(docs, id_col, text_col, owner_col, 1, None).where("n_live > 0")
    cuts = F.transform(F.filter("found", lambda s: s["live"] & (s["kind"] != "opaque")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    live = found.select("doc_id", "text_hash", cuts.alias("cuts")).where(F.size("cuts") > 0).dropDuplicates(["doc_id", "text_hash"])
    # All own columns are inside one struct, whatever the names of the others.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    both = docs.select(row.alias("row")).join(live.select("doc_id", "text_hash", "cuts"), (F.col(f"row.`{id_col}`") == F.col("doc_id")) & (F.xxhash64(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))) == F.col("text_hash")), "left")
    text = F.col(f"row.`{text_col}`")
    # Forward over the sorted spans: what lies before a span is copied, overlapping spans share a mark.
    cut = F.aggregate(
        "cuts", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.char_length(text))),
    )
    changed = F.col("cuts").isNotNull()
    out = both.select("row", changed.alias("changed"), F.when(changed, cut).otherwise(text).alias("text"))
    new = {text_col: F.col("text"), chars_col: F.when(F.col("changed"), F.char_length("text")).otherwise(F.col(f"row.`{chars_col}`"))} if chars_col in docs.columns else {text_col: F.col("text")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
