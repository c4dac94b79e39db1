"""Language identification by cross-parsing entropy.

A suffix automaton is built of labelled text of each language. A text is its
words of letters with blanks between them; it is parsed greedily, from its first
character to its last, into the longest phrases that occur in a language's text;
the language that needs fewest phrases a letter wins.

All texts of a batch are parsed at once: a lane is a text under a language, and a
step moves every lane by one character. The last, longest texts are parsed one by
one from where the lanes leave them, which gives the same phrases.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import giving_back, id_crc, identified, materialize

#: The bounded sample: labelled documents a language, whole texts of so many characters at most.
SAMPLE_DOCS, SAMPLE_LONGEST = 20, 6_000
#: Characters of texts that are parsed together, one text at least, and texts left from which on they go one by one.
BATCH_CHARS, LEAST_LANES = 4_000_000, 12
SHARPNESS = 4.0
#: So many times the labelled rows' upper spread above their median is well above; lengths with fewer labelled rows have no figures of their own.
WELL_ABOVE, LEAST_LABELLED = 4.0, 30
CODE_POINTS = 0x110000


class SuffixAutomaton:
    """Recognises every substring of a text; transitions by state and character."""

    def __init__(self, text: str):
        own: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            now = len(own)
            own.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in own[p]:
                own[p][c] = now
                p = link[p]
            if p >= 0:
                q = own[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    twin = len(own)
                    own.append(dict(own[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and own[p].get(c) == q:
                        own[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        self.step = own

    def phrases(self, text: str) -> int:
        """Phrases of the greedy cross-parsing; a character that never occurs is a phrase of its own."""
        step, n, state = self.step, 0, 0
        for c in text:
            to = step[state].get(c)
            if to is None:
                n += state > 0
                to = step[0].get(c)
                if to is None:
                    n, to = n + 1, 0
            state = to
        return n + (state > 0)


def normal_text(text: str) -> str:
    """Runs of letters (Unicode category L) in lower case, each between blanks."""
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    return f" {' '.join(words)} " if words else ""


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text by language: the whole texts of its first SAMPLE_DOCS documents by hash, of those with SAMPLE_LONGEST characters at most."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) <= SAMPLE_LONGEST)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).where(F.col("r") <= SAMPLE_DOCS)
    out: dict[str, str] = {}
    for row in sorted(first.collect(), key=lambda r: (r["lang"], r["r"])):
        if words := normal_text(row["text"]):
            out[row["lang"]] = out.get(row["lang"], " ") + words[1:]
    return out


class Parser:
    """Letters, and phrases of each language, of many texts at once."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for text in samples.values() for c in text} - {" "})
        # Codes: 0 a blank, then the samples' letters, then any other letter. A character's code comes from its code point.
        self.width = len(letters) + 2
        self.codes = np.zeros(CODE_POINTS, dtype=np.int32)
        self.codes[[k for k in range(CODE_POINTS) if unicodedata.category(chr(k))[0] == "L"]] = self.width - 1
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        at, steps, self.first = {" ": 0} | {c: k + 1 for k, c in enumerate(letters)}, [], []
        for lang in self.langs:
            own = SuffixAutomaton(samples[lang]).step
            table = np.zeros((len(own), self.width), dtype=np.int32)
            for state, moves in enumerate(own):
                for c, to in moves.items():
                    table[state, at[c]] = to
            self.first.append(sum(len(t) for t in steps))
            steps.append(table)
        # One table of all languages: a state is its language's first row and its own number; 0 stands for no move.
        self.table = np.concatenate([np.where(t > 0, t + a, 0) for t, a in zip(steps, self.first)]).astype(np.int32).ravel() if steps else np.zeros(0, dtype=np.int32)

    def stream(self, texts: list[str], prose: bool) -> tuple[np.ndarray, np.ndarray]:
        """(codes, bounds): the normal texts one after the other, each with a blank first; where each starts, and the end.

        ``prose``: tokens with digits, as codes and keys are, don't count.
        """
        padded = [f" {t.lower()} " for t in texts]
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes, starts = self.codes[points], np.cumsum([0, *map(len, padded)])
        if prose:
            token = np.cumsum((points == 32) | (points >= 9) & (points <= 13))
            coded = np.zeros(int(token[-1]) + 1, dtype=bool)
            coded[token[(points >= 48) & (points <= 57)]] = True
            codes[coded[token]] = 0
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        keep[starts[:-1]] = True
        return codes[keep], np.r_[0, np.cumsum(keep)][starts]

    def __call__(self, texts: list[str], prose: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, words, phrases by language) of each text."""
        codes, bounds = self.stream(texts, prose)
        of_text = lambda x: np.diff(np.r_[0, np.cumsum(x)][bounds])
        letters, words = of_text(codes > 0), of_text((codes > 0) & (np.r_[0, codes[:-1]] == 0))
        lengths, phrases = np.diff(bounds), np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        on = np.flatnonzero(letters > 0)
        on = on[np.argsort(-lengths[on], kind="stable")]
        first = np.array(self.first, dtype=np.int64)
        state, n, at = np.tile(first, (len(on), 1)), np.zeros((len(on), len(first)), dtype=np.int64), 0
        left = np.searchsorted(-lengths[on], -np.arange(int(lengths[on[0]]) if len(on) else 0))  # texts that have a character there
        while at < len(left) and left[at] >= LEAST_LANES:
            own = slice(0, int(left[at]))
            c = codes[bounds[on[own]] + at]
            to = self.table[state[own] * self.width + c[:, None]]
            row, lang = np.nonzero(to == 0)
            if len(row):
                # A phrase ends; the character opens the next, or is one of its own where no text has it.
                n[row, lang] += state[row, lang] != first[lang]
                root = self.table[first[lang] * self.width + c[row]]
                n[row, lang] += root == 0
                to[row, lang] = np.where(root == 0, first[lang], root)
            state[own] = to
            at += 1
        if at < len(left):
            table, width = memoryview(self.table), self.width
            for k in range(int(left[at])):
                rest = codes[bounds[on[k]] + at : bounds[on[k] + 1]].tolist()
                for lang, root in enumerate(self.first):
                    s, more = int(state[k, lang]), 0
                    for c in rest:
                        to = table[s * width + c]
                        if not to:
                            more += s != root
                            to = table[root * width + c]
                            if not to:
                                more, to = more + 1, root
                        s = to
                    state[k, lang] = s
                    n[k, lang] += more
        phrases[on] = n + (state != first)
        return letters, words, phrases

    def in_parts(self, texts: list[str], prose: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, BATCH_CHARS at a time."""
        parts, start, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_CHARS or i + 1 == len(texts):
                parts.append(self(texts[start : i + 1], prose))
                start, size = i + 1, 0
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else self([], prose)


_BUILT: dict[int, Parser] = {}


def parser_of(samples: dict[str, str]) -> Parser:
    """The samples' parser, built once a worker."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Parser(samples)
    return _BUILT[key]


def verdicts(langs: list[str], letters: np.ndarray, phrases: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, phrases a letter) of each text; ties go to the language that sorts first."""
    if not langs:
        return ["und"] * len(letters), np.zeros(len(letters)), np.ones(len(letters))
    rates = phrases / np.maximum(1, letters)[:, None]
    best = rates.argmin(axis=1)
    least = rates[np.arange(len(rates)), best]
    share = (least[:, None] / np.where(rates > 0, rates, 1.0)) ** SHARPNESS
    some = letters > 0
    return [langs[k] if ok else "und" for k, ok in zip(best, some)], np.where(some, 1 / np.where(some, share.sum(axis=1), 1.0), 0.0), np.where(some, least, 1.0)


def language_id(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, phrases_per_letter), one row a document with an id.

    A null or empty text or one without letters is ``und`` with score 0, as is
    every text when nothing was learned. Repeated rows are judged each; an empty
    table gives no rows; further columns aren't read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = parser_of(samples)
        for batch in batches:
            letters, _, phrases = parser.in_parts(batch["text"].tolist())
            lang, score, rate = verdicts(parser.langs, letters, phrases)
            yield pd.DataFrame({"id": batch["id"], "lang_pred": lang, "score": score, "phrases_per_letter": rate})

    rows = identified(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(giving_back(run), "id long, lang_pred string, score double, phrases_per_letter double").withColumnRenamed("id", id_col)


def _may_train(id_col: str) -> Column:
    return id_crc(F.col(id_col)) % 4 != 2


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose labels may be learned from."""
    return docs.where(_may_train(id_col))


def prose_excess(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, labelled, letters, length, excess), one row a document with an id: phrases beyond one a word, for each letter.

    Tokens with digits, as codes and keys are, are no prose and don't count.
    ``length`` is the bit length of the number of letters. A text without prose
    is judged by all its letters, with length 0; one without letters has letters
    0 and excess 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = parser_of(samples)
        for batch in batches:
            texts = batch["text"].tolist()
            letters, words, phrases = (x.copy() for x in parser.in_parts(texts, prose=True))
            length = np.array([int(x).bit_length() for x in letters], dtype=np.int32)
            if len(bare := np.flatnonzero(letters == 0)):
                letters[bare], words[bare], phrases[bare] = parser.in_parts([texts[i] for i in bare])
            least = phrases.min(axis=1) if parser.langs else words
            yield pd.DataFrame({"id": batch["id"], "labelled": batch["labelled"], "letters": letters, "length": length, "excess": (least - words) / np.maximum(1, letters)})

    rows = identified(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (_may_train(id_col) & F.col(lang_col).isNotNull()).alias("labelled"))
    return rows.mapInPandas(giving_back(run), "id long, labelled boolean, letters long, length int, excess double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns.

    Texts without letters go, null ones included, and those that in every
    language need more than a phrase a word and far more than labelled rows of
    that length, in all of which the limit is measured: WELL_ABOVE times their
    upper spread above the median. Lengths of fewer than LEAST_LABELLED labelled
    rows have the highest of the others' limits. With nothing learned, texts with
    letters stay. Rows without an id go; of rows that repeat an id all stay if
    one of them does.
    """
    judged = materialize(prose_excess(docs, learn(training_rows(docs, id_col), id_col, text_col, lang_col), id_col, text_col, lang_col), "excess")
    labelled = judged.where("labelled AND length > 0")
    median, upper = F.percentile_approx("excess", 0.5, 10_000), F.percentile_approx("excess", 0.95, 10_000)
    limit = F.greatest(F.lit(0.0), median + WELL_ABOVE * (upper - median))
    # Lengths are bit lengths, 64 at most.
    by_length = {r["length"]: r["most"] for r in labelled.groupBy("length").agg(limit.alias("most"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_LABELLED).collect()}
    most = F.lit(max([labelled.agg(limit.alias("most")).first()["most"] or 0.0, *by_length.values()]))
    for length, value in by_length.items():
        most = F.when(F.col("length") == length, value).otherwise(most)
    kept = judged.where((F.col("letters") > 0) & (F.col("excess") <= most)).select(F.col("id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col] == kept["_kept_id"], "left_semi")
