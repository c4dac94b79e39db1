"""Language-model scores by context-tree weighting.

A text is its words, A-Z in lower case, each closed by a blank, and one end mark.
Bytes are predicted bit by bit: each of the 255 binary nodes of a byte has a
context tree over the DEPTH bytes before it, across blanks; before the text stand
end marks. A node mixes the Krichevsky-Trofimov estimate of its own counts with
its children's mixtures, half and half, over all depths; learned once over the
training texts, the mixture weights are the posterior ones. A node without
counts predicts 1/2, as its estimate does.

1. A task puts its documents in chunks and counts a chunk's distinct words and
   distinct (context, byte) pairs, packed by part: a word's by its hash, a
   pair's by its two last context bytes, so all deeper nodes of a tree are in one
   part. Nothing is moved yet.
2. The chunks' counts of a part are added up in groups of GROUP chunks, then over
   the groups, so a part that a third of all text falls in is summed by many
   tasks.
3. The levels above (257 contexts, whatever the input) are put together on the
   driver; each part weighs its own trees and scores its pairs.
4. Each group of chunks asks its copy of a part's table; the answers go to the
   chunks, and there to the documents.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import giving_back, id_crc, identified, in_small_batches, materialize, partitions

DEPTH = 5
#: Contexts of fewer bytes are on the driver.
SPLIT = 2
END = b"\n"
#: Bytes of text of a chunk, of a piece of it whose pairs are sorted together, and chunks whose counts are added up first.
CHUNK_BYTES, PIECE_BYTES, GROUP = 32 << 20, 1 << 20, 64
#: Keys of a part that are unpacked before they are added up.
HELD_KEYS = 500_000
DOCUMENTS, WORDS, PAIRS = 0, 1, 2
_BLOBS = "kind int, part int, chunk long, data binary"
_U = np.uint64


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)


def as_bytes(words: list[bytes]) -> bytes:
    """What the model predicts of a text: its words, blanks and the end mark."""
    return b" ".join([*words, END])


def pair_keys(texts: list[bytes]) -> np.ndarray:
    """The (context, byte) pairs of all bytes of texts, one after the other.

    A key has the predicted byte lowest, then the last byte before it, and so on.
    """
    buffer = np.frombuffer(END * DEPTH + (END * DEPTH).join(texts), dtype=np.uint8).astype(np.uint64)
    key = buffer.copy()
    for k in range(1, DEPTH + 1):
        key[k:] |= buffer[:-k] << _U(8 * k)
    predicted = np.ones(len(buffer), dtype=bool)
    starts = np.cumsum([0, *[len(t) + DEPTH for t in texts[:-1]]])
    predicted[(starts[:, None] + np.arange(DEPTH)[None]).ravel()] = False
    return key[predicted]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0 by a shifted Stirling series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _node(key: np.ndarray, bit: int, depth: int) -> np.ndarray:
    """Node number of each key: context of ``depth`` bytes, then the bits of the byte before ``bit``."""
    byte = key & _U(255)
    prefix = _U(1 << bit) | (byte >> _U(8 - bit))
    return (((key >> _U(8)) & _U((1 << 8 * depth) - 1)) << _U(8)) | prefix


class Level:
    """Nodes of one depth: sorted numbers, counts, own and mixed log probability, weight of the own estimate."""

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int):
        self.depth = depth
        key, count = _summed(key & _U((1 << 8 * (depth + 1)) - 1), count)
        nodes = np.concatenate([_node(key, bit, depth) for bit in range(8)])
        ones = np.concatenate([((key >> _U(7 - bit)) & _U(1)).astype(bool) for bit in range(8)])
        counts = np.tile(count.astype(np.float64), 8)
        self.nodes, where = np.unique(nodes, return_inverse=True)
        self.ones = np.bincount(where, weights=counts * ones, minlength=len(self.nodes))
        self.zeros = np.bincount(where, weights=counts * ~ones, minlength=len(self.nodes))
        self.own = log_kt(self.zeros, self.ones)

    def weigh(self, below: np.ndarray | None) -> None:
        """``below``: the sum of the children's mixed log probabilities of each node; the deepest level has none."""
        if below is None:
            self.mixed, self.weight = self.own, np.ones(len(self.nodes))
        else:
            half = math.log(0.5)
            self.mixed = np.logaddexp(half + self.own, half + below)
            self.weight = np.exp(np.minimum(0.0, half + self.own - self.mixed))

    def parents(self, depth: int) -> np.ndarray:
        """Numbers, one depth up, of the parents of the nodes."""
        return (((self.nodes >> _U(8)) & _U((1 << 8 * depth) - 1)) << _U(8)) | (self.nodes & _U(255))

    def sums_for(self, upper: Level) -> np.ndarray:
        at = np.searchsorted(upper.nodes, self.parents(upper.depth))
        return np.bincount(at, weights=self.mixed, minlength=len(upper.nodes))

    def predict(self, key: np.ndarray, bit: int, deeper: np.ndarray) -> np.ndarray:
        """Probability of the key's bit, given what the next depth says; 1/2 without a node here."""
        if not len(self.nodes):
            return np.full(len(key), 0.5)
        node = _node(key, bit, self.depth)
        at = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
        one = ((key >> _U(7 - bit)) & _U(1)).astype(bool)
        own = (np.where(one, self.ones[at], self.zeros[at]) + 0.5) / (self.ones[at] + self.zeros[at] + 1)
        return np.where(self.nodes[at] == node, self.weight[at] * own + (1 - self.weight[at]) * deeper, 0.5)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(key)
    key, count = key[order], count[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return key[starts], np.add.reduceat(count, starts) if len(key) else count


def lower_levels(key: np.ndarray, count: np.ndarray) -> list[Level]:
    """Weighed levels of depth SPLIT and more, the deepest last."""
    seen = count > 0
    levels = [Level(key[seen], count[seen], d) for d in range(SPLIT, DEPTH + 1)]
    levels[-1].weigh(None)
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        upper.weigh(lower.sums_for(upper))
    return levels


def upper_levels(key: np.ndarray, count: np.ndarray, nodes: np.ndarray, below: np.ndarray) -> list[Level]:
    """Weighed levels above SPLIT, from counts of keys with that many context bytes less one, and sums of their children."""
    levels = [Level(key, count, d) for d in range(SPLIT)]
    at = np.searchsorted(levels[-1].nodes, nodes)
    levels[-1].weigh(np.bincount(at, weights=below, minlength=len(levels[-1].nodes)) if len(levels[-1].nodes) else np.zeros(0))
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        upper.weigh(lower.sums_for(upper))
    return levels


def log_probabilities(key: np.ndarray, upper: list[Level], lower: list[Level]) -> np.ndarray:
    """log10 of the mixture's probability of each key's byte in its context."""
    total = np.zeros(len(key))
    for bit in range(8):
        p = np.full(len(key), 0.5)
        for level in [*upper, *lower][::-1]:
            p = level.predict(key, bit, p)
        total += np.log10(p)
    return total


def _pack(key: np.ndarray, value: np.ndarray) -> bytes:
    """Sorted keys, as the steps between them, and 64-bit values."""
    return zstandard.compress(np.diff(key, prepend=_U(0)).tobytes() + value.tobytes(), 1)


def _unpack(blob: bytes, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint64)
    return np.cumsum(raw[: len(raw) // 2], dtype=np.uint64), raw[len(raw) // 2 :].view(kind)


def _added(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of packed counts, added up; no more are unpacked at once than there are distinct ones, or HELD_KEYS."""
    keys, counts, held, least = [], [], 0, HELD_KEYS
    for blob in blobs:
        key, count = _unpack(blob)
        keys.append(key)
        counts.append(count)
        held += len(key)
        if held > least:
            key, count = _summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [key], [count], len(key)
            least = held + max(held, HELD_KEYS)
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _part_of(kind: int, key: np.ndarray, parts: int) -> np.ndarray:
    """Which part a key is dealt to: a pair by its two last context bytes."""
    own = (key >> _U(8)) & _U(0xFFFF) if kind == PAIRS else key >> _U(32)
    return (own * _U(0x9E3779B1) >> _U(7)) % _U(parts)


class Tally:
    """Distinct keys of a chunk, with the counts that they have in training texts."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held, self.least = [], [], 0, 2_000_000

    def add(self, key: np.ndarray, train: np.ndarray) -> None:
        key, count = _summed(key, train)
        self.keys.append(key)
        self.counts.append(count)
        self.held += len(key)
        if self.held > self.least:
            self._merge()
            self.least = self.held + self.held // 2 + 1_000_000

    def _merge(self) -> None:
        if self.keys:
            key, count = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [key], [count], len(key)

    def blobs(self, kind: int, parts: int) -> Iterator[tuple[int, bytes]]:
        """(part, packed keys and counts)."""
        self._merge()
        for key, count in zip(self.keys, self.counts):
            part = _part_of(kind, key, parts).astype(np.int64)
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.diff(part[order], prepend=-1))
            for own in np.split(order, starts[1:]):
                yield int(part[own[0]]), _pack(key[own], count[own])


def pieces(texts: list[bytes]) -> Iterator[slice]:
    """Consecutive texts of PIECE_BYTES together, one at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_BYTES:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_chunks(rows: DataFrame, parts: int) -> DataFrame:
    """(kind, part, chunk, data) of ``rows`` (id, text, held_out): each chunk's documents, and its words and pairs by part.

    Words and pairs that only held-out texts have are there with count 0.
    Documents are a row for each piece, with its number as part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0

        def blobs(held: list[tuple[int, bool, bytes]]) -> Iterator[pd.DataFrame]:
            chunk = (task << 24) + number
            texts, train = [t for _, _, t in held], np.array([not h for _, h, _ in held], dtype=np.float64)
            words, pairs = Tally(), Tally()
            for piece, own in enumerate(pieces(texts)):
                yield pd.DataFrame({"kind": DOCUMENTS, "part": piece, "chunk": chunk, "data": [zstandard.compress(pickle.dumps(held[own]), 1)]})
                split = [[*t.split(), END] for t in texts[own]]
                words.add(word_keys([w for s in split for w in s]), np.repeat(train[own], [len(s) for s in split]))
                pairs.add(pair_keys(texts[own]), np.repeat(train[own], [len(t) for t in texts[own]]))
            for kind, tally in ((WORDS, words), (PAIRS, pairs)):
                for part, data in tally.blobs(kind, parts):
                    yield pd.DataFrame({"kind": kind, "part": part, "chunk": chunk, "data": [data]})

        held, size = [], 0
        for batch in batches:
            for doc_id, text, held_out in zip(batch["id"], batch["text"], batch["held_out"]):
                held.append((int(doc_id), bool(held_out), as_bytes(words_of(text))))
                size += len(held[-1][2])
                if size >= CHUNK_BYTES:
                    yield from blobs(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield from blobs(held)

    return rows.mapInPandas(giving_back(run), _BLOBS)


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple[int, bytes]]]]:
    """(key, [(chunk, data)]) of rows that come sorted by ``keys``."""
    value, rows = None, []
    for batch in batches:
        for *own, chunk, data in zip(*(batch[c] for c in (*keys, "chunk", "data"))):
            if tuple(own) != value and rows:
                yield value, rows
                rows = []
            value = tuple(own)
            rows.append((chunk, data))
    if rows:
        yield value, rows


def add_up(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """``blobs`` with one row a value of ``keys`` (kind and part first); ``chunk`` is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, rows in _grouped(batches, keys):
            yield pd.DataFrame({c: [x] for c, x in zip(keys, key)} | {"chunk": 0, "data": [_pack(*_added([data for _, data in rows]))]})

    dealt = blobs.repartition(partitions(blobs.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "chunk", "data").mapInPandas(giving_back(run), ", ".join(f"{c} int" for c in keys) + ", chunk long, data binary")


def learn_upper(table: DataFrame) -> list[Level]:
    """The levels above SPLIT from the parts' pairs; what reaches the driver is bounded by 257 contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: Counter = Counter()
        below: Counter = Counter()
        for _, rows in _grouped(batches, ["part"]):
            key, count = _added([data for _, data in rows])
            short, n = _summed(key & _U((1 << 8 * SPLIT) - 1), count)
            top.update(dict(zip(short[n > 0].tolist(), n[n > 0].tolist())))
            level = lower_levels(key, count)[0]
            nodes, where = np.unique(level.parents(SPLIT - 1), return_inverse=True)
            for node, value in zip(nodes.tolist(), np.bincount(where, weights=level.mixed, minlength=len(nodes)).tolist()):
                below[node] += value
        found = [(0, k, v, 0.0) for k, v in top.items()] + [(1, k, 0, v) for k, v in below.items()]
        yield pd.DataFrame(found, columns=["kind", "k", "n", "below"])

    rows = table.mapInPandas(giving_back(run), "kind int, k long, n long, below double").groupBy("kind", "k").agg(F.sum("n").alias("n"), F.sum("below").alias("below")).toPandas().sort_values(["kind", "k"])
    top, below = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    as_key = lambda x: x["k"].to_numpy(np.int64).astype(np.uint64)
    return upper_levels(as_key(top), top["n"].to_numpy(np.int64), as_key(below), below["below"].to_numpy(np.float64))


def word_totals(table: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [_unpack(data)[1] for data in batch["data"]]
            yield pd.DataFrame({"n": [int(c.sum()) for c in counts], "v": [int((c > 0).sum()) for c in counts]})

    row = table.mapInPandas(giving_back(run), "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    return int(row["n"]), int(row["v"])


def score_table(table: DataFrame, upper: list[Level]) -> DataFrame:
    """The parts' tables with, for each pair, its log10 probability instead of its count."""
    shared = table.sparkSession.sparkContext.broadcast(upper)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part, chunk, data in zip(*(batch[c] for c in ("kind", "part", "chunk", "data"))):
                if kind == PAIRS:
                    key, count = _unpack(data)
                    data = _pack(key, log_probabilities(key, shared.value, lower_levels(key, count)))
                yield pd.DataFrame({"kind": kind, "part": part, "chunk": chunk, "data": [data]})

    return table.select("kind", "part", "chunk", "data").mapInPandas(giving_back(run), _BLOBS)


def answer(asked: DataFrame, scored: DataFrame, groups: int) -> DataFrame:
    """``asked`` (kind, part, group, chunk, data) with the values of ``scored`` for its keys; each group has its copy of a part's table."""
    copies = scored.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("chunk", F.lit(-1).cast("long"))
    keys = ["kind", "part", "group"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = value = None
        for batch in batches:
            for kind, part, chunk, data in zip(*(batch[c] for c in ("kind", "part", "chunk", "data"))):
                if chunk < 0:
                    key, value = _unpack(data)
                else:
                    own = _unpack(data)[0]
                    yield pd.DataFrame({"kind": kind, "part": part, "chunk": chunk, "data": [_pack(own, value[np.searchsorted(key, own)])]})

    met = copies.select(*keys, "chunk", "data").unionByName(asked.select(*keys, "chunk", "data"))
    return met.repartition(partitions(asked.sparkSession), *keys).sortWithinPartitions(*keys, "chunk").mapInPandas(giving_back(run), _BLOBS)


def _looked_up(kind: int, key: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], parts: int) -> np.ndarray:
    """Values of keys from the sorted tables of their parts, which aren't put together: that takes several times their memory."""
    distinct, where = np.unique(key, return_inverse=True)
    part = _part_of(kind, distinct, parts).astype(np.int64)
    order = np.argsort(part, kind="stable")
    values = np.empty(len(distinct), dtype=np.int64 if kind == WORDS else np.float64)
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        keys, found = tables[int(part[own[0]])]
        values[own] = found[np.searchsorted(keys, distinct[own])]
    return values[where]


@in_small_batches
def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document with an id.

    Learned from the documents whose crc32(id as text) mod 7 is not 2. Null and
    empty texts are an end mark alone. With nothing to learn from, every
    estimate is 1/2 and the base is that of no tokens. Repeated rows count and
    are scored each; an empty table gives no rows; further columns aren't read.
    Words are told apart by 64-bit hashes.
    """
    parts = partitions(docs.sparkSession)
    rows = identified(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(id_crc(F.col(id_col)) % 7 == 2, F.lit(False)).alias("held_out"))
    counted = materialize(count_chunks(rows, parts), "chunks")
    chunks = counted.where(f"kind = {DOCUMENTS}").agg(F.count_distinct("chunk").alias("n")).first()["n"]
    groups = max(1, math.ceil(chunks / GROUP))
    asked = counted.where(f"kind <> {DOCUMENTS}").withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    table = materialize(add_up(add_up(asked, ["kind", "part", "group"]), ["kind", "part"]), "table")
    n, v = word_totals(table.where(f"kind = {WORDS}"))
    scored = materialize(score_table(table, learn_upper(table.where(f"kind = {PAIRS}"))), "scored")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, own = None, {}
        for batch in batches:
            for kind, part, number, data in zip(batch["kind"], batch["part"], batch["chunk"], batch["data"]):
                if number != chunk:
                    chunk, own = number, {WORDS: {}, PAIRS: {}}
                if kind != DOCUMENTS:
                    key, value = _unpack(data, np.int64 if kind == WORDS else np.float64)
                    own[kind][part] = key, value.copy()  # a view would hold the packed keys too
                    continue
                held = pickle.loads(zstandard.decompress(data))
                texts = [t for _, _, t in held]
                split = [[*t.split(), END] for t in texts]
                lengths = np.array([len(t) for t in texts])
                tokens = np.array([len(s) for s in split])
                c = _looked_up(WORDS, word_keys([w for s in split for w in s]), own[WORDS], parts)
                first = np.cumsum(tokens) - tokens
                score = np.add.reduceat(_looked_up(PAIRS, pair_keys(texts), own[PAIRS], parts), np.cumsum(lengths) - lengths)
                yield pd.DataFrame({
                    "id": [d for d, _, _ in held], "held_out": [h for _, h, _ in held], "n_tokens": tokens, "n_known": np.add.reduceat((c > 0).astype(np.int64), first), "train_tokens": n,
                    "base_score": np.add.reduceat(np.log10((c + 1.0) / (n + v + 1)), first), "score": score, "bits_per_byte": -score / math.log10(2) / lengths,
                })

    met = answer(asked, scored, groups).unionByName(counted.where(f"kind = {DOCUMENTS}"))
    found = met.repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("kind") == DOCUMENTS, "kind", "part")
    scores = found.mapInPandas(giving_back(judge), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return materialize(scores, "scores").withColumnRenamed("id", id_col)
