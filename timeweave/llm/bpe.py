"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are cut into pieces by the vocabulary's pattern, and each block of texts
has its distinct pieces listed. Spark folds the ranked merges over their byte
arrays: in each step the pair of lowest rank, the leftmost of equals, is merged.
The ranks are a literal map from pairs of ids, laid out in an array so that a
look-up doesn't depend on its size. Pieces that a bounded
sample shows to be common are folded once beforehand. Decoding concatenates the
binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import identified

#: Pieces of a block, after which its distinct ones are folded.
BLOCK_PIECES = 2_000_000
#: Folding costs the square of a piece's bytes; longer pieces are merged with a heap instead.
FOLD_BYTES = 128
#: The bounded table of common pieces: one text in COMMON_SAMPLE is looked at.
COMMON_SAMPLE, COMMON_PIECES = 16, 200_000
_SLOTS = 1 << 19


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece of a file with a base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of the merged piece for each pair of pieces that make one."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


@lru_cache(maxsize=4)
def rank_map(path: str) -> tuple[list[int], list[int]]:
    """(base, slots): slot base[a] + b has ((a + 1) << 17) | rank if a and b merge, else something with other high bits.

    Each piece's row of partners is laid into the slots where it finds them free,
    longest rows first, so a look-up is two array reads.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    ranks = load_ranks(path)
    for (a, b), rank in pair_ranks(ranks).items():
        rows.setdefault(a, []).append((b, rank))
    base, slots = [0] * len(ranks), np.zeros(_SLOTS + len(ranks), dtype=np.int64)
    draw = np.random.default_rng(1)
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        b, rank = (np.array(x, dtype=np.int64) for x in zip(*row))
        while True:
            tried = draw.integers(0, _SLOTS, 32)
            free = (slots[tried[:, None] + b[None]] == 0).all(axis=1)
            if free.any():
                break
        base[a] = int(tried[free.argmax()])
        slots[base[a] + b] = ((a + 1) << 17) | rank
    return base, slots.tolist()


def fold_merges(piece: Column, path: str) -> Column:
    """Ids of a piece given as an array of byte values."""
    ranks = load_ranks(path)
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    base, slots = map(literal, rank_map(path))
    of_byte = literal(ranks[bytes([b])] for b in range(256))

    def step(ids: Column, _: Column) -> Column:
        # A pair's rank, or more than any rank.
        found = F.transform(F.slice(ids, 2, F.size(ids)), lambda b, i: slots[base[ids[i]] + b].bitwiseXOR(F.shiftleft(ids[i] + 1, 17)))
        least = F.array_min
        merged = lambda f: F.when(least(f) < F.lit(1 << 17), F.concat(
            F.slice(ids, F.lit(1), F.array_position(f, least(f)).cast("int") - 1), F.array(least(f)), F.slice(ids, F.array_position(f, least(f)).cast("int") + 2, F.size(ids)),
        )).otherwise(ids)
        return F.transform(F.array(found), merged)[0]

    start = F.transform(piece, lambda b: of_byte[b])
    return F.when(F.size(piece) < 2, start).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(piece), F.lit(2))), start, step))


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long piece: the same merges, with a heap of pairs over a linked list."""
    n = len(piece)
    end, back, on = [i + 1 for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
            continue
        alive[middle], end[i], on[i] = False, stop, on[middle]
        if on[i] < n:
            back[on[i]] = i
            k = on[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if back[i] >= 0 and (r := ranks.get(piece[back[i] : stop])) is not None:
            heapq.heappush(heap, (r, back[i], i, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def common_pieces(docs: DataFrame, pattern: str, path: str) -> dict[str, bytes]:
    """Ids of the pieces that are most frequent in a sample of texts, folded by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(find(text))
            kept = [(p, n) for p, n in counts.items() if len(p) <= FOLD_BYTES // 4]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["piece", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_SAMPLE)) == 0)
    counted = sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    most = counted.orderBy(F.col("n").desc(), "piece").limit(COMMON_PIECES).select("piece")

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), _lists([p.encode() for p in pieces])], ["piece", "bytes"])

    spread = most.repartition(8)
    rows = spread.mapInArrow(as_bytes, "piece string, bytes array<int>").select("piece", fold_merges(F.col("bytes"), path).cast("array<int>").alias("ids")).toArrow()
    ids = rows.column("ids").combine_chunks()
    flat, offsets = ids.flatten().to_numpy().astype("<u4"), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())] if len(ids) else np.zeros(1, dtype=np.int64)
    return {p: flat[offsets[k] : offsets[k + 1]].tobytes() for k, p in enumerate(rows.column("piece").to_pylist())}


def _lists(pieces: list[bytes]) -> pa.Array:
    """Byte arrays as an array of lists of integers."""
    offsets = np.zeros(len(pieces) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in pieces], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int32)))


_BLOCK = "doc_ids binary, sizes binary, places binary, known binary, new array<array<int>>"


def encode_blocks(docs: DataFrame, pattern: str, path: str) -> DataFrame:
    """Blocks of texts with the ids of their distinct pieces, folded in the block's row."""
    table = docs.sparkSession.sparkContext.broadcast(common_pieces(docs, pattern, path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import regex
        import zstandard

        find, common, ranks = regex.compile(pattern).findall, table.value, load_ranks(path)
        at: dict[str, int] = {}
        doc_ids, sizes, places = [], [], []

        def flush() -> pa.RecordBatch:
            known, new, where = {}, [], []
            for piece, k in at.items():
                if (ids := common.get(piece)) is not None:
                    known[k] = ids
                elif len(raw := piece.encode("utf-8", "replace")) > FOLD_BYTES:
                    known[k] = np.array(heap_merges(raw, ranks), dtype="<u4").tobytes()
                else:
                    new.append(raw)
                    where.append(k)
            blob = zstandard.compress(pickle.dumps((known, where)), 1)
            row = [np.array(doc_ids, dtype=np.int64).tobytes(), np.array(sizes, dtype=np.int64).tobytes(), zstandard.compress(np.concatenate(places).astype(np.uint32).tobytes(), 1), blob]
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in row], pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), _lists(new))], ["doc_ids", "sizes", "places", "known", "new"])

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                pieces = find(text)
                places.append(np.fromiter((at.setdefault(p, len(at)) for p in pieces), dtype=np.int64, count=len(pieces)))
                doc_ids.append(doc_id)
                sizes.append(len(pieces))
                held += len(pieces)
                if held >= BLOCK_PIECES:
                    yield flush()
                    at, doc_ids, sizes, places, held = {}, [], [], [], 0
        if doc_ids:
            yield flush()

    blocks = docs.mapInArrow(cut, _BLOCK)
    return blocks.select("doc_ids", "sizes", "places", "known", F.transform("new", lambda p: fold_merges(p, path).cast("array<int>")).alias("new"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text.

    Ids are those of the ranked merges in each match of ``pattern``, as
    little-endian unsigned 32-bit integers; decoding gives the text's bytes where
    the pattern matches all of it. Null is empty. Repeated rows are encoded each;
    rows without an id are left out; an empty table gives no rows; further columns aren't read.
    """
    rows = identified(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import zstandard

        ranks = load_ranks(path)
        pieces = [b""] * len(ranks)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes = (np.frombuffer(batch.column(c)[k].as_py(), dtype=np.int64) for c in ("doc_ids", "sizes"))
                places = np.frombuffer(zstandard.decompress(batch.column("places")[k].as_py()), dtype=np.uint32)
                known, where = pickle.loads(zstandard.decompress(batch.column("known")[k].as_py()))
                new = batch.column("new")[k].values
                flat = new.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                ends = np.cumsum(new.value_lengths().to_numpy(zero_copy_only=False)) if len(new) else np.zeros(0, dtype=np.int64)
                coded = [b""] * (len(known) + len(where))
                for number, ids in known.items():
                    coded[number] = ids
                start = 0
                for number, end in zip(where, ends.tolist()):
                    coded[number] = flat[start:end].tobytes()
                    start = end
                out, first = [], 0
                for doc_id, size in zip(doc_ids.tolist(), sizes.tolist()):
                    ids = b"".join([coded[p] for p in places[first : first + size].tolist()])
                    first += size
                    decoded = hashlib.sha256(b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])).hexdigest()
                    out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded, *([ids] if with_ids else [])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(4 + with_ids)], [c.split()[0] for c in columns.split(", ")])

    return encode_blocks(rows, pattern, path).mapInArrow(assemble, columns)
