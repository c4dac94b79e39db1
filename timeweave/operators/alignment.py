"""Token alignment and text echo: fuzzy longest common subsequences and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions import scalars as X

from timeweave.operators.intervals import range_join


def edit_distance(a: str, b: str, limit: int) -> int | None:
    """the number of edits, or None beyond the limit."""
    if abs(len(a) - len(b)) > limit:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > limit:
            return None
        row = new
    return row[-1] if row[-1] <= limit else None


def tokens_match(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    limit = 0 if n <= 4 else 1 if n <= 7 else 2
    return a == b if not limit else edit_distance(a, b, limit) is not None


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """pairs of places of a longest common subsequence of matching tokens."""
    n, m = len(a), len(b)
    hit = [[tokens_match(x, y) for y in b] for x in a]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if hit[i][j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if hit[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(pairs: DataFrame) -> DataFrame:
    """(pair_id, matches, similarity) of pairs of token lists; similarity is 2 matches / tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [len(align(list(a), list(b))) for a, b in zip(batch["a"], batch["b"])]
            total = [max(1, len(a) + len(b)) for a, b in zip(batch["a"], batch["b"])]
            yield pd.DataFrame({"pair_id": batch["pair_id"], "matches": n, "similarity": [2 * x / t for x, t in zip(n, total)]})

    return pairs.select("pair_id", "a", "b").mapInPandas(run, "pair_id string, matches long, similarity double")


def timing(pairs: Sequence[tuple[int, int]]) -> tuple[int, int] | None:
    """The upper median of delays (mic - system) and the largest deviation from it."""
    if not pairs:
        return None
    delays = sorted(m - s for m, s in pairs)
    middle = delays[len(delays) // 2]
    return middle, max(abs(d - middle) for d in delays)


def text_echo(phrases: DataFrame, tokens: DataFrame, before_ms: int = 1500, after_ms: int = 500, least: int = 3, similarity: float = 0.6, deviation_ms: int = 1500) -> DataFrame:
    """Microphone phrases that repeat what the system said about then.

    ``phrases`` have phrase_id and sorted tokens (t, start_ms); ``tokens`` are the
    system's. Candidates meet phrases by a bucketed range join; each phrase with
    its candidates, both bounded by the phrase's span, is aligned by itself.
    """
    met = range_join(phrases, tokens, (F.col("start_ms") - before_ms, F.col("end_ms") + after_ms), (F.col("start_ms"), F.col("end_ms")), keys=("session_id",))
    near = met.where("r_end_ms >= start_ms - %d AND r_start_ms <= end_ms + %d" % (before_ms, after_ms))
    listed = near.groupBy("session_id", "phrase_id").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("r_start_ms", "r_token"))).alias("said"))
    schema = "session_id long, phrase_id string, matches long, similarity double, delay_ms long, deviation_ms long, echo boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                mine, said = list(row.tokens), list(row.said)
                pairs = align([x["t"] for x in mine], [x["r_token"] for x in said])
                when = timing([(mine[i]["start_ms"], said[j]["r_start_ms"]) for i, j in pairs])
                share = len(pairs) / max(1, len(mine))
                delay, spread = when or (0, 0)
                out.append((row.session_id, row.phrase_id, len(pairs), share, delay, spread, len(pairs) >= least and share >= similarity and spread <= deviation_ms))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return listed.mapInPandas(run, schema)


def assign_window(scores: np.ndarray) -> list[int | None]:
    """Distinct columns of the highest sum for as many rows as there are columns, at most; a row beyond them gets none.

    Each row can do with its n best columns, n being the number of rows. Choices
    are searched in depth; one that can't beat the best sum, even with every
    later row's best column, is left.
    """
    rows, columns = scores.shape
    own = [np.sort(np.lexsort((np.arange(columns), -s))[:rows]).tolist() for s in scores]
    ahead = np.r_[np.cumsum([0.0, *[max(0.0, float(s.max())) for s in scores[::-1]]])[::-1]] if columns else np.zeros(rows + 1)
    need, best, found = min(rows, columns), -np.inf, [None] * rows
    stack: list[tuple[tuple, float, int]] = [((), 0.0, 0)]
    while stack:
        chosen, total, used = stack.pop()
        row = len(chosen)
        if row == rows:
            if total > best:
                best, found = total, list(chosen)
            continue
        if total + ahead[row] < best:
            continue
        # The last pushed is tried first: columns in order, then none.
        if need - used < rows - row:
            stack.append(((*chosen, None), total, used))
        if used < need:
            stack += [((*chosen, c), total + float(scores[row, c]), used + 1) for c in reversed(own[row]) if c not in chosen]
    return found


def assigned_windows(items: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The speakers of each window to distinct clusters; those left over to the most similar.

    Every row comes back; a window has as many as the model's local speakers,
    three, and more only cost more time.
    """

    def run(window: pd.DataFrame) -> pd.DataFrame:
        window = window.sort_values("row")
        scores = np.array(window["v"].tolist()) @ centroids.T
        found = assign_window(scores)
        return pd.DataFrame({"win": window["win"], "row": window["row"], "cluster": [int(scores[i].argmax()) if c is None else c for i, c in enumerate(found)]})

    return items.groupBy("win").applyInPandas(run, "win long, row long, cluster int")


#: Tokens beyond this length meet at pieces, as the ways to leave out two characters grow with its square.
MOST_LEFT_OUT = 24


def left_out(w: Column, edits: int) -> Column:
    """All that is left of a token without up to ``edits`` of its characters, two at most."""
    once = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    one = once(w)
    return F.array_distinct(F.concat(F.array(w), one, F.flatten(F.transform(one, once))) if edits == 2 else F.concat(F.array(w), one))


def near_tokens(tokens: DataFrame) -> DataFrame:
    """(a, b), a < b, of distinct tokens ``w`` within the limit of edits, whatever their first letters.

    Two tokens within the limit share what is left without as many characters of
    each, and meet there. Long ones meet at a piece: of the limit + 1 pieces of the
    shorter token one is in the other as it is, moved by the limit at most. Tokens
    of up to four characters match only themselves.

    A token has hundreds of rests, of which Spark's estimate knows nothing, so joins
    are by merging: a small table would be sent to the driver with all its rests.
    """
    n = F.length("w")
    cut = lambda k: F.floor(k * F.col("len") / 3).cast("int")
    split = lambda rows: rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("at", cut(F.col("k"))).withColumn("size", cut(F.col("k") + 1) - F.col("at"))

    def meet(rows: DataFrame, edits: int) -> DataFrame:
        kept = rows.select("w", F.explode(left_out(F.col("w"), edits)).alias("rest"))
        met = kept.alias("l").hint("merge").join(kept.alias("r"), F.col("l.rest") == F.col("r.rest"))  # the sides are alike, and shuffled once
        return met.where("l.w < r.w").select(F.col("l.w").alias("a"), F.col("r.w").alias("b"))

    short = meet(tokens.where(n.between(5, 8)), 1).where("least(length(a), length(b)) <= 7")
    middle = meet(tokens.where(n.between(8, MOST_LEFT_OUT + 2)), 2)
    long = tokens.where(n > MOST_LEFT_OUT)
    pieces = split(long.select("w", n.alias("len"))).select("w", "len", "k", F.substring("w", F.col("at") + 1, F.col("size")).alias("piece"))
    others = split(long.select(F.col("w").alias("o"), F.explode(F.sequence(F.greatest(F.lit(MOST_LEFT_OUT + 1), n - 2), n)).alias("len")))
    others = others.withColumn("shift", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("at", F.col("at") + F.col("shift")).where("at >= 0 AND at + size <= length(o)")
    probes = others.select("o", "len", "k", F.substring("o", F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    far = pieces.hint("merge").join(probes, ["len", "k", "piece"]).where("w <> o").select(F.least("w", "o").alias("a"), F.greatest("w", "o").alias("b"))
    return short.unionByName(middle).unionByName(far).distinct().where(X.tokens_match(F.col("a"), F.col("b")))
