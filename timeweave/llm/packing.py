"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the
number of documents) goes to the driver. There, sets that provably dominate every
other set with their largest item are fixed, which shrinks the instance, and the
rest is packed best-fit decreasing; both steps handle all bins of one shape at
once. The plan says where the n-th piece of a length goes; executors rank the
pieces of each length and look their places up.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import giving_back, identified, materialize, partitions

#: Distinct words whose ids a worker remembers, over all its tasks.
CACHE_WORDS = 1_200_000


class WordEncoder:
    """Ids of whole texts from remembered ids of their words.

    The tokenizer lower-cases, drops white space before its merges and cuts
    between letters and punctuation, so a text's ids are those of its words, put
    together, and a word's those of its letters and of the punctuation after
    them. Words are cut at ASCII white space only, a subset of what the tokenizer
    itself cuts at, and A-Z go to lower case first. Letters are cut from
    punctuation only where the tokenizer's own normal form of them has nothing
    but letters, of the blocks up to LAST_LETTER, that any Unicode version knows.
    """

    TAIL = b".,;:!?%$&*#|-"
    LAST_LETTER = "\u024f"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _all_letters(self, word: bytes) -> bool:
        """Whether the tokenizer sees one run of letters."""
        if word.isalpha():  # ASCII
            return True
        text = word.decode()
        return text.isalpha() and max(text) <= self.LAST_LETTER and self.tokenizer.normalizer.normalize_str(text).isalpha()

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words that aren't known."""
        known, cut, new = self.known, [], set()
        for word in words:
            if word not in known:
                core = word.rstrip(self.TAIL)
                if core and len(core) < len(word) and self._all_letters(core):
                    cut.append((word, core))
                    new.update(x for x in (core, word[len(core) :]) if x not in known)
                else:
                    new.add(word)
        letters = [word for word in new if self._all_letters(word)]
        if letters:
            # Each is a word of the tokenizer, so one call does for all.
            found = self.tokenizer.encode(b" ".join(letters).decode(), add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in letters]
            if (found.word_ids or [-1])[-1] == len(letters) - 1:
                for number, x in zip(found.word_ids, found.ids):
                    ids[number].append(x)
                known.update((word, struct.pack(f"<{len(x)}I", *x)) for word, x in zip(letters, ids))
        order = [word for word in new if word not in known]
        for word, x in zip(order, self.tokenizer.encode_batch([word.decode() for word in order], add_special_tokens=False)):
            known[word] = struct.pack(f"<{len(x.ids)}I", *x.ids)
        for word, core in cut:
            known[word] = known[core] + known[word[len(core) :]]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        raw = text.encode("utf-8", "replace")
        words = (raw if b"<|" in raw else raw.lower()).split()  # a special token's name is matched as it is written
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self._learn(words)
            return b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder, with the words that its earlier tasks met."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each text and an end id, cut only beyond ``capacity``."""
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer_path)
        step = 4 * capacity
        for batch in batches:
            # A batch of many long texts is encoded in parts, which bounds the ids held at once.
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                out = []
                for doc_id, text in zip(part["doc_id"], part["text"]):
                    ids = encoder.encode(text) + end
                    for piece, start in enumerate(range(0, len(ids), step)):
                        own = ids[start : start + step]
                        out.append((doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    return identified(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(giving_back(run), columns)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed bins as (lengths, how many), what remains).

    From the largest length j down, with the room that it leaves and k, the
    largest partner that fits:

    * no partner fits: {j} is fixed;
    * k fills the room, no two items fit together, or no three do and no pair is
      longer than k: {j, k} dominates every feasible set with j;
    * no three fit, k is in the longest pair {k, b} that fits, and no two items
      longer than b fit: {j, k, b} dominates, as of any pair one item is at most
      as long as k and the other as b.
    """
    left, fixed = dict(counts), []
    lengths = sorted(left)
    changed = True

    def drop(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            lengths.remove(length)

    def smallest(n: int, without: int, above: int = 0) -> list[int]:
        """The ``n`` smallest items longer than ``above``, without one of length ``without``."""
        out: list[int] = []
        for length in lengths[bisect.bisect_right(lengths, above) :]:
            out += [length] * min(n - len(out), left[length] - (length == without))
            if len(out) >= n:
                break
        return out

    def longest_pair(room: int, without: int) -> int:
        """The length of the longest two items that fit together, without one of length ``without``; 0 if none do."""
        usable = [x for x in lengths[: bisect.bisect_right(lengths, room)] if left[x] > (x == without)]
        best, i, k = 0, 0, len(usable) - 1
        while i <= k:
            a, b = usable[i], usable[k]
            if a + b > room:
                k -= 1
            else:
                if a != b or left[a] - (a == without) >= 2:
                    best = max(best, a + b)
                i += 1
        return best

    def dominating(j: int, room: int, k: int) -> tuple[int, ...]:
        """The partners of a dominating set, none where none is proven."""
        few = smallest(3, j)
        if k == room or len(few) < 2 or few[0] + few[1] > room:
            return (k,)
        if len(few) == 3 and sum(few) <= room:
            return ()
        pair = longest_pair(room, j)
        if pair <= k:
            return (k,)
        b = pair - k
        if b not in left or Counter((j, k, b))[b] > left[b] or b > k:
            return ()
        longer = smallest(2, j, above=b)
        return (k, b) if len(longer) < 2 or sum(longer) > room else ()

    while changed:
        changed = False
        for j in sorted(lengths, reverse=True):
            while j in left:
                room = capacity - j
                at = bisect.bisect_right(lengths, room) - 1
                if at >= 0 and lengths[at] == j and left[j] < 2:
                    at -= 1
                partners = dominating(j, room, lengths[at]) if at >= 0 else ()
                if at >= 0 and not partners:
                    break
                own = Counter((j, *partners))
                n = min(left[length] // times for length, times in own.items())
                fixed.append(((j, *partners), n))
                for length, times in own.items():
                    drop(length, n * times)
                changed = True
    return fixed, left


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The L2 bound on the number of bins: for each length up to half a bin, items that need a bin each and what the rest fill beyond them."""
    lengths = sorted(counts)
    best = -(-sum(length * n for length, n in counts.items()) // capacity)
    for least in [0, *[x for x in lengths if 2 * x <= capacity]]:
        alone = sum(counts[x] for x in lengths if x > capacity - least)
        halves = [x for x in lengths if capacity - least >= x > capacity / 2]
        room = sum(counts[x] * (capacity - x) for x in halves)
        rest = sum(counts[x] * x for x in lengths if least <= x <= capacity / 2)
        best = max(best, alone + sum(counts[x] for x in halves) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram: bins as (((length, times), ...), how many)."""
    opened: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def add(room: int, shape: tuple, n: int) -> None:
        if n:
            if room not in opened:
                bisect.insort(rooms, room)
                opened[room] = []
            opened[room].append((shape, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                add(capacity - each * length, ((length, each), None), todo // each)
                if todo % each:
                    add(capacity - todo % each * length, ((length, todo % each), None), 1)
                break
            room = rooms[at]
            shape, n = opened[room].pop()
            if not opened[room]:
                del opened[room]
                rooms.pop(at)
            each = room // length
            full = min(n, todo // each)
            add(room - each * length, ((length, each), shape), full)
            todo -= full * each
            if full < n:
                some = todo  # fewer than each
                if some:
                    add(room - some * length, ((length, some), shape), 1)
                add(room, shape, n - full - bool(some))
                todo = 0

    out = []
    for shapes in opened.values():
        for shape, n in shapes:
            chain, node = [], shape
            while node is not None:
                chain.append(node[0])
                node = node[1]
            out.append((tuple(reversed(chain)), n))
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, dict[str, int]]:
    """Segments (length, first rank, times a bin, first sequence, offset) sorted by (length, first rank), and figures."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    bins = [(tuple(Counter(lengths).items()), n) for lengths, n in fixed]
    bins += best_fit(rest, capacity)
    rank: dict[int, int] = {}
    segments, sequence = [], 0
    for shape, n in bins:
        offset = 0
        for length, times in shape:
            start = rank.get(length, 0)
            segments.append((length, start, times, sequence, offset))
            rank[length] = start + n * times
            offset += length * times
        sequence += n
    return np.array(sorted(segments), dtype=np.int64).reshape(-1, 5), {"sequences": sequence, "fixed": sum(n for _, n in fixed), "bound": lower_bound(counts, capacity)}


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` among rows of the same length, from 0.

    A length that a third of all rows have is spread over buckets: they are
    counted, the counts give each bucket its first rank, and rows are numbered
    within buckets.
    """
    n = max(16, partitions(rows.sparkSession))
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    counts = spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return spread.join(first, ["length", "_bucket"]).withColumn("rank", F.coalesce("_first", F.lit(0)) + within - 1).drop("_bucket", "_first")


def pack(rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    The plan sent to executors has one row a length and shape of bin; lengths and
    residuals are at most ``capacity``, so its size has a bound that doesn't
    depend on the number of documents.
    """
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, _ = plan(counts, capacity)
    table = rows.sparkSession.sparkContext.broadcast(segments)
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = table.value
        keys = found[:, 0] * (1 << 48) + found[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            own = found[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            yield batch.drop(columns="rank").assign(sequence_id=own[:, 3] + nth // own[:, 2], offset=own[:, 4] + nth % own[:, 2] * length)

    return ranked(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(giving_back(run), columns)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise ``docs`` and pack the pieces: one row a piece with its sequence and place.

    A null or empty text is its end id alone. Equal lengths are interchangeable,
    ranked by (hash bucket, doc_id, piece, ids_crc32); repeated rows are packed
    each by itself; rows without an id are left out. An empty table gives no rows; further columns aren't read.
    """
    return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)
