"""Exact n-gram Jaccard self-join with set-relation skipping, as links between classes.

A document's set has the 64-bit hashes of its 5-word shingles.

1. Equal sets form a class; only its smallest document goes on.
2. Classes of one min-hash are compared with the smallest of them, the centre.
   Those that link to it are its members: a star of highly similar sets.
3. Every class puts the first shingles of its set, in one global order, into
   index lists; sets that link share one of them. The order is that of the
   hashes, with shingles that a sample shows to be frequent last. A list whose
   entries are of one star is skipped whole; in the others, pairs of a star are
   skipped, as are blocks of sizes and positions that can't reach the overlap.
   Sets that link share not one but many lists; pairs of stars that share fewer
   are skipped too. Neighbours in the lists are compared first: they connect most
   of a large group, and only pairs of stars of different components go on.
   The stars of lists of more than LONG_LIST entries meet as sets, in blocks by
   size: a task compares all their centres and gives the links that connect
   components, so a pair there is no row, and the pairs of the other lists are
   at most LONG_LIST / 2 times their entries. Overlapping long lists meet
   together where that takes fewer comparisons.
4. Their centres are compared. A member's answer is derived from its centre's:
   the Jaccard distance is a metric, so members a, b of centres A, B can link
   only if d(A, B) <= 0.2 + d(a, A) + d(b, B). Only those members meet, in
   blocks, and only where the centres aren't connected yet; a task tells which
   stars it found linked, so pairs of members are no rows.
5. Links between centres, stars and classes give components.
6. All links are within components: there the classes meet in blocks, those of
   large components by size, and every pair is compared. A task adds up its
   links, so pairs are no rows.

No step drops, caps or samples sets: the sample only decides an order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import attach, giving_back, in_small_batches, materialize, partitions, per_group
from timeweave.llm.components import connected_components

WORDS = 5
#: Links are 100 * intersection >= 80 * union, so 9 * intersection >= 4 * (size + size).
#: Characters of text hashed at once.
SHINGLE_BYTES = 2_000_000
#: For the order: one document in ORDER_SAMPLE is looked at, shingles of ORDER_LEAST and more of them count as frequent, ORDER_MOST at most.
ORDER_SAMPLE, ORDER_LEAST, ORDER_MOST = 32, 3, 200_000
#: Members that meet a centre in one task, and entries of a list in one block.
STAR_BLOCK, LIST_BLOCK = 400, 1500
#: Entries of a list above which its stars meet as sets.
LONG_LIST = 64
#: Index entries that a task packs together.
HELD_ENTRIES = 400_000
#: Pairs of stars that a task holds to add them up.
HELD_PAIRS = 1_000_000
#: Shingles of the sets of one block, one set at least.
BLOCK_SHINGLES = 1_000_000
_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are hashed in parts of SHINGLE_BYTES, one text at least."""
    part, size = [], 0
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split()
        part.append(words)
        size += len(text)
        if size >= SHINGLE_BYTES:
            yield from _shingle_part(part)
            part, size = [], 0
    yield from _shingle_part(part)


def _shingle_part(texts: list[list[bytes]]) -> Iterator[np.ndarray]:
    h = np.array([xxhash.xxh3_64_intdigest(w) for words in texts for w in words], dtype=np.uint64)
    full = max(0, len(h) - WORDS + 1)
    total = np.zeros(full, dtype=np.uint64)
    for k in range(WORDS):
        total += h[k : full + k] * _MULTIPLIERS[k]
    total, at = mix(total, WORDS), 0  # those that reach into the next text aren't looked at
    for words in texts:
        n = len(words)
        if n >= WORDS:
            s = np.sort(total[at : at + n - WORDS + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        else:
            yield mix(np.array([(h[at : at + n] * _MULTIPLIERS[:n]).sum(dtype=np.uint64)]), n) if n else np.zeros(0, dtype=np.uint64)
        at += n


def _i64(x: np.ndarray | np.uint64) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _class_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size, 128-bit key in two halves and min-hash of each set; 0 for empty sets."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    out = [np.zeros(len(sets), dtype=np.uint64) for _ in range(3)]
    if n.sum():
        every, full = np.concatenate(sets), n > 0
        starts = (np.cumsum(n) - n)[full]
        for x, of, seed in zip(out, (np.add, np.add, np.minimum), (11, 12, 13)):
            x[full] = of.reduceat(mix(every, seed), starts)
    return n, *map(_i64, out)


def _parts(sets: Iterator[np.ndarray], most: int = 500_000) -> Iterator[list[np.ndarray]]:
    """Sets in lists of about ``most`` hashes."""
    part, size = [], 0
    for s in sets:
        part.append(s)
        size += len(s)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n, ka, kb, mh): size, 128-bit key and min-hash of each set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for sets in _parts(shingle_sets(batch["text"])):
                n, ka, kb, mh = _class_keys(sets)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(sets)].to_numpy(), "n": n, "ka": ka, "kb": kb, "mh": mh})
                at += len(sets)

    return docs.mapInPandas(giving_back(run), "doc_id long, n long, ka long, kb long, mh long")


_COMPARED = "a long, b long, common long, na long, nb long"


def compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, na, nb) of each pair of document ids.

    Texts of the documents in question go to where their pairs are: an ``a`` with
    many partners meets them in several tasks. Documents that can't be in a pair
    are sorted out before the shuffle by their hash bucket, of which there are
    2^20 at most, whatever the number of pairs.
    """
    salts = F.ceil(F.col("m") / STAR_BLOCK).cast("int")
    pairs = materialize(pairs.select("a", "b").distinct(), "asked")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], _COMPARED)
    counted = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")), "a")
    dealt = materialize(counted.select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("part")), "pairs")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    asked = dealt.select(F.col("a").alias("doc_id")).union(dealt.select(F.col("b").alias("doc_id"))).select(bucket.alias("_bucket")).distinct()
    near = docs.withColumn("_bucket", bucket).join(F.broadcast(asked), "_bucket", "left_semi").drop("_bucket")
    members = dealt.withColumnRenamed("b", "doc_id").join(near, "doc_id").select("a", "part", F.col("doc_id").alias("b"), "text")
    anchors = dealt.select(F.col("a").alias("doc_id"), "part").distinct().join(near, "doc_id").select(F.col("doc_id").alias("a"), "part", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, key = np.zeros(0, dtype=np.uint64), None
        for batch in batches:
            out = []
            for a, b, s in zip(batch["a"], batch["b"], shingle_sets(batch["text"])):
                if pd.isna(b):
                    key, own = a, s
                elif key == a:
                    small, large = (own, s) if len(own) < len(s) else (s, own)
                    at = np.searchsorted(large, small)
                    common = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    out.append((a, int(b), common, len(own), len(s)))
            yield pd.DataFrame(out, columns=["a", "b", "common", "na", "nb"])

    meeting = anchors.unionByName(members).repartition(partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialize(meeting.mapInPandas(giving_back(run), _COMPARED).distinct(), "compared")


_LINKED = "9 * common >= 4 * (na + nb)"
_DISTANCE = "1 - common / (na + nb - common)"


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that come last in the global order, sorted, with their rank there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sets in _parts(shingle_sets(batch["text"])):
                values, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"h": _i64(values), "n": counts})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SAMPLE)) == 0)
    counted = sample.mapInPandas(giving_back(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= ORDER_LEAST)
    rows = counted.orderBy(F.col("n").desc(), "h").limit(ORDER_MOST).collect()
    hashes = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    rank = np.argsort(np.argsort([(r["n"]) for r in rows], kind="stable"), kind="stable") if rows else np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    return np.stack([hashes[order], rank[order].astype(np.uint64)])


def prefixes(sets: list[np.ndarray], frequent: np.ndarray) -> list[np.ndarray]:
    """The first len - ceil(0.8 len) + 1 shingles of each sorted set in the global order."""
    size = lambda s: len(s) - (4 * len(s) + 4) // 5 + 1
    if not frequent.shape[1]:
        return [s[: size(s)] for s in sets]
    every = np.concatenate(sets)
    where = np.minimum(np.searchsorted(frequent[0], every), frequent.shape[1] - 1)
    often, out, at = frequent[0][where] == every, [], 0
    for s in sets:
        own = slice(at, at + len(s))
        at, k = at + len(s), size(s)
        rare = s[~often[own]][:k]
        if len(rare) < k:
            last = np.flatnonzero(often[own])
            rare = np.concatenate([rare, s[last[np.argsort(frequent[1][where[own][last]], kind="stable")]]])[:k]
        out.append(rare)
    return out


_ENTRY = np.dtype([("h", "<u8"), ("ka", "<i8"), ("n", "<u4"), ("at", "<u4")])


def index_lists(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, ka, n, at): entries of lists with more than one class; ``at`` is the place of h in the class's set.

    Entries travel packed, a blob for each HELD_ENTRIES and list partition; a
    class is put in once among these, however many documents it has.
    """
    n = partitions(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(parts: list[np.ndarray]) -> pd.DataFrame:
            entries = np.concatenate(parts)
            where = (mix(entries["h"], 21) % _U(n)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            entries, where = entries[order], where[order]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            return pd.DataFrame({"part": where[starts].astype(np.int32), "data": [x.tobytes() for x in np.split(entries, starts[1:])]})

        seen, parts, held = set(), [], 0
        for batch in batches:
            for sets in _parts(shingle_sets(batch["text"])):
                keys, fresh = _class_keys(sets)[1].tolist(), []
                for s, key in zip(sets, keys):
                    if len(s) and key not in seen:
                        seen.add(key)
                        fresh.append((s, key))
                if fresh:
                    first = prefixes([s for s, _ in fresh], table.value)
                    entries = np.empty(sum(map(len, first)), dtype=_ENTRY)
                    entries["h"] = np.concatenate(first)
                    entries["ka"], entries["n"] = (np.repeat(np.array(x), [len(p) for p in first]) for x in ([key for _, key in fresh], [len(s) for s, _ in fresh]))
                    entries["at"] = np.concatenate([np.arange(len(p)) for p in first])
                    parts.append(entries)
                    held += len(entries)
                if held >= HELD_ENTRIES:
                    yield packed(parts)
                    seen, parts, held = set(), [], 0
        if parts:
            yield packed(parts)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lists(blobs: list[bytes]) -> Iterator[pd.DataFrame]:
            e = np.frombuffer(b"".join(blobs), dtype=_ENTRY)
            e = e[np.lexsort((e["ka"], e["h"]))]
            e = e[np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["ka"][1:] != e["ka"][:-1])]]
            same = np.r_[False, e["h"][1:] == e["h"][:-1]]
            e = e[same | np.r_[same[1:], False]]
            for at in range(0, len(e), 100_000):
                x = e[at : at + 100_000]
                yield pd.DataFrame({"h": _i64(x["h"].copy()), "ka": x["ka"], "n": x["n"].astype(np.int64), "at": x["at"].astype(np.int64)})

        part, blobs = None, []
        for batch in batches:
            for p, data in zip(batch["part"], batch["data"]):
                if p != part and blobs:
                    yield from lists(blobs)
                    blobs = []
                part = p
                blobs.append(data)
        if blobs:
            yield from lists(blobs)

    packed = docs.mapInPandas(giving_back(emit), "part int, data binary").repartition(n, "part").sortWithinPartitions("part")
    return packed.mapInPandas(giving_back(gather), "h long, ka long, n long, at long")


def least_shared(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many early index lists sets of these sizes share at least if they link.

    With an overlap of o, a set has n - o elements of its own, so the j-th common
    element is at place j + n - o at the latest, and those that this leaves
    within both prefixes are in both sets' lists. Half of them are asked for: the
    j-th then has n + 1 - o - j elements after it, which ``list_pairs`` looks at.
    """
    o = (4 * (na + nb) + 8) // 9
    length = lambda n: n - (4 * n + 4) // 5 + 1
    return (np.maximum(1, np.minimum(length(na) - (na - o), length(nb) - (nb - o))) + 1) // 2


def list_pairs(lists: np.ndarray, stars: np.ndarray, groups: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, least_shared) of entries of stars of different groups that size and position in their list allow to link.

    Entries come by list, then size. Each is compared with the next, the second
    next and so on of its list, until sizes are beyond 1.25 times its own: the
    rest of the list is skipped. A pair is given once for each list.
    """
    rest, ends = sizes - places, np.searchsorted(lists, lists, side="right")
    on, step, out = np.arange(len(lists)), 1, []
    while True:
        on = on[on + step < ends[on]]
        on = on[4 * sizes[on + step] <= 5 * sizes[on]]
        if not len(on):
            break
        to = on + step
        o = (4 * (sizes[on] + sizes[to]) + 8) // 9
        least = least_shared(sizes[on], sizes[to])
        # From the j-th common element on, j = least at most, the overlap less j - 1 has to fit.
        ok = (np.minimum(rest[on], rest[to]) + least - 1 >= o) & (groups[on] != groups[to])
        if ok.any():
            a, b = stars[on[ok]], stars[to[ok]]
            out.append((lists[on[ok]], np.minimum(a, b), np.maximum(a, b), least[ok]))
        step += 1
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    number, a, b, least = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((number, b, a))
    number, a, b, least = number[order], a[order], b[order], least[order]
    starts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[starts], b[starts], np.minimum.reduceat(least, starts)


def star_lists(lists: DataFrame, stars: DataFrame) -> DataFrame:
    """(h, center, n, at): the index lists with the stars of their entries, each size of a star once."""
    entries = lists.join(stars.select("ka", "center"), "ka")
    return materialize(entries.groupBy("h", "center", "n").agg(F.min("at").alias("at")), "lists")


def _in_blocks(entries: DataFrame, label: str) -> DataFrame:
    """Entries of lists with more than one ``label``, long lists dealt to blocks."""
    mixed = entries.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi")
    rows = attach(entries, mixed.select("h", "m"), ["h"], "center").withColumn("nb", F.ceil(F.col("m") / LIST_BLOCK).cast("int"))
    return rows.withColumn("own", F.pmod(F.xxhash64("center", "n"), F.col("nb")).cast("int"))


def measured_lists(entries: DataFrame) -> DataFrame:
    """Entries of lists with more than one component, with the entries of their list as ``m``."""
    mixed = entries.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return attach(entries, mixed.select("h", "m"), ["h"], "center")


def neighbours(entries: DataFrame) -> DataFrame:
    """(a, b): stars that are next to each other, or to the first, in several lists.

    These are few, as many as entries at most, and find most links of large
    groups; the pairs of stars that they connect needn't be looked at again.
    """
    w = Window.partitionBy("h", "own").orderBy("center", "n")
    near = _in_blocks(entries, "center").select("center", "n", F.lag("center").over(w).alias("before"), F.lag("n").over(w).alias("nb"), F.first("center").over(w).alias("head"), F.first("n").over(w).alias("nh"))
    pairs = near.select(F.col("before").alias("a"), F.col("center").alias("b"), "n", F.col("nb").alias("o")).union(near.select(F.col("head").alias("a"), F.col("center").alias("b"), "n", F.col("nh").alias("o")))
    fits = "a <> b AND 5 * n >= 4 * o AND 5 * o >= 4 * n"
    counted = pairs.where(fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("n", "o")).alias("n"))
    return counted.where("shared >= 2 + n DIV 50").select("a", "b")


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("shared", "<i4"), ("least", "<i4")])


def added_pairs(parts: list[np.ndarray]) -> np.ndarray:
    """Pairs (a, b, shared, least) of all parts once each, with the sum of ``shared`` and the smallest ``least``; the parts are used up."""
    pairs = np.concatenate(parts)
    parts.clear()
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    starts = np.flatnonzero(np.r_[True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])])
    shared, least = np.add.reduceat(pairs["shared"], starts), np.minimum.reduceat(pairs["least"], starts)
    pairs = pairs[starts]
    pairs["shared"], pairs["least"] = shared, least
    return pairs


def _in_frames(pairs: np.ndarray, most: int = 100_000) -> Iterator[pd.DataFrame]:
    """``pairs`` as frames of at most ``most`` rows."""
    for at in range(0, len(pairs), most):
        yield pd.DataFrame({c: pairs[c][at : at + most].astype(np.int64) for c in _PAIR.names})


def candidate_stars(entries: DataFrame) -> DataFrame:
    """(a, b): pairs of stars, not connected yet, whose members share index lists enough to link.

    ``entries`` have the component that each star is known to be in.
    """
    rows = _in_blocks(entries, "component").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "center", "component", "n", "at")
    key, columns = ["h", "i", "j"], ["center", "component", "n", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(rows: np.ndarray) -> np.ndarray:
            lists = np.cumsum(np.r_[0, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            a, b, least = list_pairs(lists, *rows[:, 3:].T)
            return added_pairs([np.rec.fromarrays([a, b, np.ones(len(a)), least], dtype=_PAIR)])

        # A pair is in many lists: a task adds its pairs up before they leave it, HELD_PAIRS at a time.
        held, found, size, bound = np.zeros((0, 7), dtype=np.int64), [], 0, HELD_PAIRS
        for batch in batches:
            held = np.concatenate([held, batch[key + columns].to_numpy(np.int64)])
            # The last block may go on in the next batch; blocks have a bounded number of entries.
            last = int(np.argmax((held[:, :3] == held[-1, :3]).all(axis=1))) if len(held) else 0
            if last:
                found.append(counted(held[:last]))
                held, size = held[last:], size + len(found[-1])
            if size > bound:
                found = [added_pairs(found)]
                size = len(found[0])
                bound = size + HELD_PAIRS
                if size > 2 * HELD_PAIRS:
                    yield from _in_frames(found[0])
                    found, size, bound = [], 0, HELD_PAIRS
        if len(held):
            found.append(counted(held))
        if found:
            found = added_pairs(found)
            yield from _in_frames(found)

    n = partitions(entries.sparkSession)
    pairs = rows.repartition(n, *key).sortWithinPartitions(*key, "n", "at").mapInPandas(giving_back(run), "a long, b long, shared long, least long")
    return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b")


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the overlaps of the sets of ``left`` and ``right``, as a matrix; a range of hashes at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    both = [*left, *right]
    ranges = sum(map(len, both)) // BLOCK_SHINGLES + 1
    bounds = [_U(k * (2**64 // ranges)) for k in range(1, ranges)]
    cuts = [np.r_[0, np.searchsorted(s, np.array(bounds, dtype=np.uint64)), len(s)].astype(np.int64) for s in both]
    for k in range(ranges):
        own = [s[c[k] : c[k + 1]] for s, c in zip(both, cuts)]
        sizes = [len(s) for s in own]
        values, codes, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(both)), sizes)
        shared = counts[codes] > 1
        column, owner = (np.cumsum(counts > 1) - 1)[codes[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for at in range(0, int((counts > 1).sum()), 4096):
            x = slice(*np.searchsorted(column, [at, at + 4096]))
            dense = np.zeros((len(both), min(4096, int(column[-1]) + 1 - at)), dtype=np.float32)
            dense[owner[x], column[x] - at] = 1
            out += dense[: len(left)] @ dense[len(left) :].T
    return out


def links_between(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets link, as a matrix."""
    sizes = [np.array([len(s) for s in sets]) for sets in (left, right)]
    return 9 * common_shingles(left, right) >= 4 * (sizes[0][:, None] + sizes[1][None])


def number_of_blocks(count: Column, shingles: Column) -> Column:
    """Blocks of about STAR_BLOCK sets and BLOCK_SHINGLES shingles at most."""
    return F.greatest(F.ceil(count / STAR_BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (rep, ...) with the texts; documents that can't be asked for are sorted out before the shuffle by hash bucket (2^20 at most)."""
    bucket = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << 20))
    asked = rows.select(bucket("rep").alias("_bucket")).distinct()
    moved = texts.withColumn("_bucket", bucket("doc_id")).join(F.broadcast(asked), "_bucket", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    return rows.join(moved, "rep")


def in_meetings(batches: Iterator[pd.DataFrame], keys: list[str], carried: str = "size") -> Iterator[tuple[tuple, list[dict], list[list[np.ndarray]]]]:
    """(key, ``carried`` by rep of both sides, sets of both sides) of each meeting of two blocks.

    Rows (*keys, side, rep, ``carried``, text) come sorted by key; a repeated rep counts once a side.
    """
    now, sizes, sets = None, [{}, {}], [[], []]
    for batch in batches:
        for *own, side, rep, size, s in zip(*(batch[c] for c in (*keys, "side", "rep", carried)), shingle_sets(batch["text"])):
            if tuple(own) != now:
                if now is not None:
                    yield now, sizes, sets
                now, sizes, sets = tuple(own), [{}, {}], [[], []]
            if rep not in sizes[side]:
                sizes[side][rep] = size
                sets[side].append(s)
    if now is not None:
        yield now, sizes, sets


def member_links(texts: DataFrame, stars: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """(u, v): centres of stars of which members link, among ``open_pairs`` (a, b, d) of centres.

    The larger star of a pair is host to members of the smaller; guests of all
    pairs of a host are pooled. Hosts and guests meet in blocks, so a set is
    copied once for each block that it meets and a pair of members is never a row.
    """
    own = materialize(stars.groupBy("center").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("m")), "radius")
    side = lambda name: own.select(F.col("center").alias(name), F.col("far").alias(f"f{name}"), F.col("m").alias(f"m{name}"))
    reach = open_pairs.join(side("a"), "a").join(side("b"), "b").where("d <= 0.2000001 + fa + fb AND fa + fb > 0")
    first = (F.col("ma") > F.col("mb")) | ((F.col("ma") == F.col("mb")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    met = materialize(reach.select(pick("a", "b").alias("host"), pick("b", "a").alias("center"), (F.col("d") - 0.2000001 - pick("fa", "fb")).alias("least"), (F.col("d") - 0.2000001 - pick("fb", "fa")).alias("host_least")), "open")
    guests = met.join(stars.select("center", F.col("doc_id").alias("rep"), "n", "far"), "center").where("far >= least").select("host", "rep", "n", F.lit(1).alias("side"))
    least = met.groupBy("host").agg(F.min("host_least").alias("least"))
    hosts = attach(stars.select(F.col("center").alias("host"), F.col("doc_id").alias("rep"), "n", "far"), least, ["host"], "rep").where("far >= least").select("host", "rep", "n", F.lit(0).alias("side"))
    both = materialize(hosts.union(guests.distinct()), "meeting")
    counts = both.groupBy("host").pivot("side", [0, 1]).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    blocks = counts.where("`0_m` > 0 AND `1_m` > 0").select("host", number_of_blocks(F.col("0_m"), F.col("0_s")).alias("nh"), number_of_blocks(F.col("1_m"), F.col("1_s")).alias("ng"))
    placed = attach(both, blocks, ["host"], "rep")
    mine, others = F.when(F.col("side") == 0, F.col("nh")).otherwise(F.col("ng")), F.when(F.col("side") == 0, F.col("ng")).otherwise(F.col("nh"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    block = lambda of: F.when(F.col("side") == of, F.col("own")).otherwise(F.col("other")).alias("ij"[of])
    keys = ["host", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (host, _, _), members, sets in in_meetings(batches, keys):
            if sets[0] and sets[1]:
                linked = links_between(*sets).any(axis=0)
                yield pd.DataFrame({"rep": [r for r, x in zip(members[1], linked) if x], "v": host}).astype("int64")

    dealt = with_texts(placed.select("host", block(0), block(1), "side", "rep", F.lit(1).alias("size")), texts)
    meeting = dealt.repartition(partitions(texts.sparkSession), *keys).sortWithinPartitions(*keys, "side", "rep")
    found = meeting.mapInPandas(giving_back(run), "rep long, v long").distinct()
    return found.join(stars.select(F.col("doc_id").alias("rep"), F.col("center").alias("u")), "rep").select("u", "v").distinct()


def in_size_blocks(rows: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """(group, rep, *carried, lo, hi, i, j, side) of ``rows`` (group, rep, n, *carried), one for each meeting of two blocks of a group.

    Groups of more than STAR_BLOCK meet only with sizes that may link, which are
    of the same power of 1.25 or the next.
    """
    counted = per_group(rows, [group], "rep", {"m": ("count", "rep")}).where("m > 1")
    banded = counted.withColumn("band", F.when(F.col("m") <= STAR_BLOCK, 0).otherwise(F.floor(F.log(1.25, F.col("n")))).cast("int"))
    blocks = per_group(banded, [group, "band"], "rep", {"k": ("count", "rep"), "s": ("sum", "n")}).withColumn("nb", number_of_blocks(F.col("k"), F.col("s")))
    own = materialize(blocks.select(group, "rep", *carried, "m", "band", "nb", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int").alias("own")), "blocks")
    heads = own.where(F.col("m") > STAR_BLOCK).select(group, "band", "nb").distinct()
    each = lambda rows, n: rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    near = lambda step: attach(own, heads.select(group, (F.col("band") + step).alias("band"), F.col("nb").alias("no")), [group, "band"], "rep")
    key = lambda lo, hi, i, j, side: (group, "rep", *carried, lo.alias("lo"), hi.alias("hi"), i.alias("i"), j.alias("j"), side.alias("side"))
    band, mine, other = F.col("band"), F.col("own"), F.col("other")
    dealt = each(own, "nb").select(*key(band, band, F.least(mine, other), F.greatest(mine, other), (mine > other).cast("int")))
    dealt = dealt.union(each(near(-1), "no").select(*key(band, band + 1, mine, other, F.lit(0))))
    return dealt.union(each(near(1), "no").select(*key(band - 1, band, other, mine, F.lit(1))))


def long_list_groups(entries: DataFrame) -> DataFrame:
    """(group, center, n, component) of the entries of long lists: what has to meet.

    Lists that share stars are one group where that takes no more comparisons
    than each of them does, as where a large group of near copies has many lists.
    """
    least = entries.groupBy("center").agg(F.min("h").alias("v"))
    clusters = connected_components(entries.select("center", F.col("h").alias("u")).join(least, "center").select("u", "v").distinct())
    within = attach(entries, clusters.withColumnRenamed("node", "h").withColumnRenamed("component", "cluster"), ["h"], "center", "left").withColumn("cluster", F.coalesce("cluster", "h"))
    within = materialize(within, "clusters")
    alone = within.select("cluster", "h", "m").distinct().groupBy("cluster").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("alone"))
    together = within.select("cluster", "center", "n").distinct().groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("k"))
    pooled = alone.join(together, "cluster").select("cluster", (F.col("k") * F.col("k") <= F.col("alone")).alias("pooled"))
    return attach(within, pooled, ["cluster"], "center").select(F.when(F.col("pooled"), F.col("cluster")).otherwise(F.col("h")).alias("group"), "center", "n", "component").distinct()


def long_list_links(texts: DataFrame, entries: DataFrame, stars: DataFrame) -> DataFrame:
    """(a, b, d, linked) of centres in long lists: links that connect components, and pairs of which members may link.

    ``entries`` have the component that each star is known to be in. All centres
    of a list are compared, but those of components that a task has found connected.
    """
    radius = stars.groupBy("center").agg(F.max("far").alias("far"))
    rows = long_list_groups(entries).join(radius, "center").select("group", F.col("center").alias("rep"), "n", F.struct("component", "far").alias("star"))
    keys = ["group", "lo", "hi", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, lo, hi, i, j), stars, sets in in_meetings(batches, keys, "star"):
            if (lo, i) == (hi, j):
                stars, sets = [stars[0]] * 2, [sets[0]] * 2
            if not sets[0] or not sets[1]:
                continue
            reps = [np.array(list(x), dtype=np.int64) for x in stars]
            known = [[x["component"] for x in side.values()] for side in stars]
            far = [np.array([x["far"] for x in side.values()]) for side in stars]
            n = [np.array([len(s) for s in side], dtype=np.float64) for side in sets]
            common, total = common_shingles(*sets), n[0][:, None] + n[1][None]
            linked, d = 9 * common >= 4 * total, 1 - common / (total - common)
            root = {c: c for side in known for c in side}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            labels = lambda: [np.array([find(c) for c in side], dtype=np.int64) for side in known]
            apart = lambda x: x[0][:, None] != x[1][None]
            out = []
            for x, y in np.argwhere(linked & apart(labels())).tolist():
                u, v = find(known[0][x]), find(known[1][y])
                if u != v:
                    root[max(u, v)] = min(u, v)
                    out.append((x, y))
            reach = far[0][:, None] + far[1][None]
            more = np.argwhere((reach > 0) & (d <= 0.2000001 + reach) & apart(labels()))
            at = np.concatenate([np.array(out, dtype=np.int64).reshape(-1, 2), more])
            a, b = reps[0][at[:, 0]], reps[1][at[:, 1]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d[at[:, 0], at[:, 1]], "linked": np.arange(len(at)) < len(out)})

    dealt = with_texts(in_size_blocks(rows, "group", ["star"]), texts)
    meeting = dealt.repartition(partitions(texts.sparkSession), *keys).sortWithinPartitions(*keys, "side", "rep")
    return materialize(meeting.mapInPandas(giving_back(run), "a long, b long, d double, linked boolean").distinct(), "long")


def link_counts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, linked): documents of other classes that link to each class, of ``classes`` (rep, n, component, size).

    Classes of a component meet in blocks; those of more than STAR_BLOCK only
    with sizes that may link, which are of the same power of 1.25 or the next.
    """
    dealt = in_size_blocks(classes, "component", ["size"])
    keys = ["component", "lo", "hi", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, lo, hi, i, j), sizes, sets in in_meetings(batches, keys):
            reps, size = [list(x) for x in sizes], [np.array(list(x.values()), dtype=np.float64) for x in sizes]
            if (lo, i) == (hi, j):
                # A block with itself: all pairs but a class's own.
                met = links_between(sets[0], sets[0]) & ~np.eye(len(sets[0]), dtype=bool)
                yield pd.DataFrame({"rep": reps[0], "linked": met @ size[0]}).astype("int64")
            elif sets[0] and sets[1]:
                met = links_between(*sets)
                yield pd.DataFrame({"rep": reps[0] + reps[1], "linked": np.r_[met @ size[1], met.T @ size[0]]}).astype("int64")

    meeting = with_texts(dealt, texts).repartition(partitions(texts.sparkSession), *keys).sortWithinPartitions(*keys, "side", "rep")
    return meeting.mapInPandas(giving_back(run), "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (doc_id, text), sets (doc_id, n, ...) and classes (doc_id, ka, n, mh, rep) of the documents with an id."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = materialize(features(texts), "sets")
    return texts, sets, materialize(per_group(sets.where("n > 0"), ["ka", "kb", "n"], "doc_id", {"rep": ("min", "doc_id")}).select("doc_id", "ka", "n", "mh", "rep"), "classes")


def class_components(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, n, component) of each class: its size and the smallest rep that links reach."""
    reps = classes.where("doc_id = rep").select("doc_id", "ka", "n", "mh").distinct()
    near = per_group(reps, ["mh"], "doc_id", {"center": ("min", "doc_id")}).where("doc_id <> center")
    compared = compare(texts, near.select(F.col("center").alias("a"), F.col("doc_id").alias("b")))
    members = compared.where(_LINKED).select(F.col("b").alias("doc_id"), F.col("a").alias("_center"), F.expr(_DISTANCE).alias("_far"))
    stars = reps.join(members, "doc_id", "left").select("doc_id", "ka", "n", F.coalesce("_center", "doc_id").alias("center"), F.coalesce("_far", F.lit(0.0)).alias("far"))
    stars = materialize(stars, "stars")

    entries = star_lists(index_lists(texts, frequent_shingles(texts)), stars)
    first = compare(texts, neighbours(entries))
    components = connected_components(first.where(_LINKED).select(F.col("a").alias("u"), F.col("b").alias("v")))
    as_links = lambda found: found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    placed = lambda rows: attach(rows, components.withColumnRenamed("node", "center"), ["center"], "h", "left").withColumn("component", F.coalesce("component", "center"))
    lists = materialize(measured_lists(placed(entries)), "measured")
    long_lists, far = lists.where(F.col("m") > LONG_LIST), None
    if not long_lists.isEmpty():
        far = long_list_links(texts, long_lists, stars)
        components = connected_components(as_links(components).union(far.where("linked").select("a", "b")))
    pairs = candidate_stars(placed(lists.where(F.col("m") <= LONG_LIST).drop("component", "m"))).join(first.select("a", "b"), ["a", "b"], "left_anti")
    met = first.unionByName(compare(texts, pairs))
    components = connected_components(as_links(components).union(met.where(_LINKED).select("a", "b")))

    known = lambda name: components.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    open_pairs = met.where(f"NOT ({_LINKED})").select("a", "b", F.expr(_DISTANCE).alias("d"))
    if far is not None:
        open_pairs = open_pairs.union(far.where("NOT linked").select("a", "b", "d")).distinct()
    open_pairs = open_pairs.join(known("a"), "a", "left").join(known("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "d")
    open_pairs = materialize(open_pairs, "open")
    if not open_pairs.isEmpty():
        more = materialize(member_links(texts, stars, open_pairs), "more")
        if not more.isEmpty():
            components = connected_components(as_links(components).union(more))
    return attach(stars.select(F.col("doc_id").alias("rep"), "n", "center"), components.withColumnRenamed("node", "center"), ["center"], "rep", "left").select("rep", "n", F.coalesce("component", "center").alias("component"))


@in_small_batches
def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every document with an id.

    Words are runs without ASCII white space, A-Z in lower case; a text of fewer
    than five words is one shingle; null, empty and blank texts have no shingles
    and are components of their own. ``component_id`` is the smallest id that
    links reach; ``n_links`` is the number of other documents that the document
    links to, equal ones included. Rows that repeat an id are one document,
    given once for each row. An empty table gives no rows; further columns
    aren't read.
    """
    texts, sets, classes = _classes(docs, id_col, text_col)
    documents = classes.select("doc_id", "rep").distinct()
    sized = materialize(class_components(texts, classes).join(documents.groupBy("rep").agg(F.count(F.lit(1)).alias("size")), "rep"), "sized")
    counted = sized.join(materialize(link_counts(texts, sized), "linked"), "rep", "left").select("rep", F.col("component").alias("component_id"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    of_class = attach(documents, counted, ["rep"], "doc_id").select(F.col("doc_id").alias("_id"), "component_id", "n_links")
    out = sets.join(of_class, F.col("doc_id") == F.col("_id"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@in_small_batches
def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, with all their columns.

    Documents without shingles stay, those without an id go; of rows that repeat
    an id all stay or none.
    """
    texts, sets, classes = _classes(docs, id_col, text_col)
    first = class_components(texts, classes).where("rep = component").select(F.col("rep").alias("_kept_id"))
    kept = first.union(sets.where("n = 0").select("doc_id")).distinct()
    return docs.join(kept, docs[id_col] == kept["_kept_id"], "left_semi")
