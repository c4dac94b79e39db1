"""Toxicity scores after noisy-channel deobfuscation.

A disguised word (leetspeak, separators, repeated or spaced letters) is a lattice
of the letters that each of its characters may stand for. Viterbi decoding under
a trigram character model restores the likeliest word; the score is that of the
restored text.

A run of single characters, and a token with separators, is decoded into words:
the lattice has word ends as well, and words of the lexicon as edges.

All that is learned comes from all labelled documents that may be learned from: the
character model, the lexicon, the weights of words and of word beginnings, and a logistic
curve from a document's toxic weight to its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import id_crc, identified, materialize

#: What a feature needs: a share of the toxic documents, documents, and odds; and the share of all documents that a word of the lexicon is in.
LEAST_SHARE, LEAST_DOCS, LEAST_ODDS, MOST_ODDS = 0.01, 4, 3.0, 8.0
LEXICON_SHARE = 4 / 7500
STEMS = (4, 5, 6)
CACHE_WORDS = 300_000
#: What a character may stand for, and what may stand between letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = set(".-_*~'`^·•,:;/\\")
#: Channel costs (natural logs): a stand-in, a separator, a repeated letter.
STAND_IN, SEPARATED, REPEATED = math.log(0.5), math.log(0.4), math.log(0.3)
#: ln of the share of words that aren't in the lexicon.
UNKNOWN = math.log(0.1)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """What was learned; empty tables score every text alike."""

    weights: dict[str, float] = field(default_factory=dict)
    trigrams: dict[str, int] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    slope: float = 0.0
    intercept: float = -4.0


class Lexicon:
    """ln of the probabilities of the lexicon's words, and all their beginnings."""

    def __init__(self, words: dict[str, int]):
        total = sum(words.values())
        self.cost = {w: math.log(n / total) for w, n in words.items()}
        self.beginnings = {w[:k] for w in words for k in range(1, len(w) + 1)}


class CharacterModel:
    """Interpolated trigram probabilities of letters; ``^`` starts and ``$`` ends a word."""

    def __init__(self, trigrams: dict[str, int]):
        self.three = trigrams
        self.two: dict[str, int] = {}
        self.pair: dict[str, int] = {}
        self.one: dict[str, int] = {}
        for t, n in trigrams.items():
            self.two[t[:2]] = self.two.get(t[:2], 0) + n
            self.pair[t[1:]] = self.pair.get(t[1:], 0) + n
            self.one[t[2]] = self.one.get(t[2], 0) + n
        self.middle: dict[str, int] = {}
        for t, n in self.pair.items():
            self.middle[t[0]] = self.middle.get(t[0], 0) + n
        self.total = max(1, sum(self.one.values()))

    def cost(self, before: str, letter: str) -> float:
        """ln of the probability of ``letter`` after the two letters ``before``."""
        three = self.three.get(before + letter, 0) / self.two[before] if before in self.two else 0.0
        two = self.pair.get(before[1] + letter, 0) / self.middle[before[1]] if before[1] in self.middle else 0.0
        return math.log(0.7 * three + 0.2 * two + 0.09 * self.one.get(letter, 0) / self.total + 1e-4)


def options(token: str, k: int) -> list[tuple[str, float]] | None:
    """The (letter, cost) that a token's k-th character may stand for, "" for nothing; None if it is no part of a word."""
    c = token[k]
    if c.isalpha():
        edges = [(c, 0.0)]
    elif c in LEET:
        edges = [(letter, STAND_IN) for letter in LEET[c]]
    else:
        return [("", SEPARATED)] if c in SEPARATORS else None
    if k and token[k - 1] == c:
        edges.append(("", REPEATED))
    return edges


def lattice(token: str) -> list[list[tuple[str, float]]] | None:
    """For each character the (letter, cost) it may stand for, "" for nothing; None if the token is no disguised word."""
    if not token:
        return None
    out, odd, letters = [], False, 0
    for k, c in enumerate(token):
        if (edges := options(token, k)) is None:
            return None
        if c.isalpha():
            letters += 1
            odd |= k > 1 and token[k - 1] == c and token[k - 2] == c
        else:
            odd = True
        out.append(edges)
    return out if odd and letters else None


def spelled(letters: tuple | None) -> str:
    """The text of a path, which is (path before, letter)."""
    out = []
    while letters is not None:
        letters, letter = letters
        out.append(letter)
    return "".join(reversed(out))


def restore(token: str, model: CharacterModel) -> str | None:
    """The likeliest word behind a disguised token of any length, by Viterbi over its lattice."""
    edges = lattice(token)
    if edges is None:
        return None
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for choices in edges:
        after: dict[str, tuple[float, tuple | None]] = {}
        for before, (total, word) in states.items():
            for letter, cost in choices:
                state = before[1] + letter if letter else before
                value = total + cost + (model.cost(before, letter) if letter else 0.0)
                if state not in after or value > after[state][0]:
                    after[state] = (value, (word, letter) if letter else word)
        states = after
    return max((total + model.cost(state, "$"), spelled(word)) for state, (total, word) in states.items())[1] or None


def segment(token: str, model: CharacterModel, lexicon: Lexicon, anywhere: bool) -> list[str]:
    """The likeliest words behind a run of characters of any length: the lattice has word ends too.

    A word is one of the lexicon (states ``#`` and its beginning) or is spelled
    by the character model. It ends after any character (``anywhere``) or at a
    separator, and where a character is no part of a word.
    """
    Path = tuple[float, tuple | None]
    states: dict[str, Path] = {"^^": (0.0, None)}

    def ended() -> Path:
        done = []
        for state, (total, path) in states.items():
            if state == "^^":
                done.append((total, state, path))
            elif state[0] != "#":
                done.append((total + model.cost(state, "$"), state, path))
            elif state[1:] in lexicon.cost:
                done.append((total + lexicon.cost[state[1:]], state, path))
        total, _, path = max(done, key=lambda x: x[:2])
        return total, (path, " ")

    for k, c in enumerate(token):
        choices = options(token, k)
        if choices is None:
            states = {"^^": ended()}
            continue
        after: dict[str, Path] = {}

        def reach(state: str, total: float, path: tuple | None) -> None:
            if state not in after or total > after[state][0]:
                after[state] = (total, path)

        for before, (total, path) in states.items():
            for letter, cost in choices:
                if not letter:
                    reach(before, total + cost, path)
                    continue
                if before == "^^" or before[0] == "#":
                    beginning = letter if before == "^^" else before[1:] + letter
                    if beginning in lexicon.beginnings:
                        reach("#" + beginning, total + cost, (path, letter))
                if before[0] != "#":
                    start = UNKNOWN if before == "^^" else 0.0
                    reach(before[1] + letter, total + cost + start + model.cost(before, letter), (path, letter))
        states = after
        if anywhere or c in SEPARATORS:
            total, path = ended()
            if "^^" not in states or total > states["^^"][0]:
                states["^^"] = (total, path)
    return spelled(ended()[1]).split()


def word_features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[f"^{word[:n]}" for n in STEMS if len(word) > n]]


def spaced_words(tokens: list[str]) -> list[str]:
    """Runs of three and more single characters, put together."""
    out, run = [], []
    for token in [*tokens, "  "]:
        if len(token) == 1:
            run.append(token)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


class Scorer:
    """Toxic weight of texts, from remembered weights of tokens."""

    def __init__(self, model: Model):
        self.model, self.letters, self.lexicon = model, CharacterModel(model.trigrams), Lexicon(model.words)
        self.known: dict[str, float] = {}

    def of_word(self, word: str) -> float:
        weights = self.model.weights
        return max((weights.get(f, 0.0) for f in word_features(word)), default=0.0)

    def of_token(self, token: str) -> float:
        """A token's weight as it stands or restored, whichever is higher."""
        plain = sum(self.of_word(w) for w in _LETTERS.findall(token))
        core = token.strip("\"'()[]{}<>?,;:.*#%&~`^-_/\\=")
        best = plain
        for form in {core, core.rstrip("!")}:
            if (word := restore(form, self.letters)) is not None:
                best = max(best, self.of_word(word))
                if any(c in SEPARATORS for c in form):
                    best = max(best, sum(self.of_word(w) for w in segment(form, self.letters, self.lexicon, False)))
        return best

    def of_run(self, run: str) -> float:
        """The weight of single characters in a row, as one word or as the words that they spell, whichever is higher."""
        word = restore(run, self.letters) or run
        return max(self.of_word(word), self.of_word(run), sum(self.of_word(w) for w in segment(run, self.letters, self.lexicon, True)))

    def __call__(self, text: str) -> float:
        tokens, known = text.lower().split(), self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            total = sum([known[t] for t in tokens])
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = self.of_token(t)
            total = sum([known[t] for t in tokens])
        if sum([len(t) == 1 for t in tokens]) >= 3:
            for run in spaced_words(tokens):
                total += self.of_run(run)
        return total

    def score(self, text: str) -> float:
        """Between 0 and 1."""
        return 1 / (1 + math.exp(-(self.model.intercept + self.model.slope * math.log1p(self(text)))))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of all labelled documents that may be learned from; equal texts are one, toxic if any of them is.

    Texts are told apart by 128 bits of hashes, so only those that are learned from
    meet their labels, once; these are never broadcast, as their number has no bound.
    """
    own = labels.where((id_crc(F.col(id_col)) % 3 != 1) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    texts = identified(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (id_crc(F.col("id")) % 3 != 1))
    texts = texts.withColumn("_h", F.xxhash64("text")).withColumn("_g", F.xxhash64(F.lit(1), "text"))
    one = texts.select("id", "_h", "_g").hint("merge").join(own, "id").groupBy("_h", "_g").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    found = texts.hint("merge").join(one, ["id", "_h", "_g"]).groupBy("id", "_h", "_g").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return materialize(found.select("text", "toxic"), "sample")


def fit_curve(rows: DataFrame) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve through rows (x, y, n) with a small penalty, by Newton steps; Spark adds the rows up."""
    w, penalty = np.zeros(2), np.diag([0.1, 0.001])
    for _ in range(50):
        z = F.least(F.greatest(F.col("x") * float(w[0]) + float(w[1]), F.lit(-30.0)), F.lit(30.0))
        p = 1 / (1 + F.exp(-z))
        missed, spread = F.col("n") * (p - F.col("y")), F.col("n") * p * (1 - p)
        sums = {"gx": missed * F.col("x"), "g1": missed, "xx": spread * F.col("x") * F.col("x"), "x1": spread * F.col("x"), "one": spread}
        r = rows.agg(*[F.sum(c).alias(name) for name, c in sums.items()]).first()
        step = np.linalg.solve(np.array([[r["xx"], r["x1"]], [r["x1"], r["one"]]]) + penalty, np.array([r["gx"], r["g1"]]) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled documents; an empty one if they lack either class."""
    sample = training_sample(docs, labels, id_col, text_col, label_col)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents with each feature, and occurrences of trigrams (of kind 1, counted as clean)."""
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            words: Counter = Counter()
            features: dict[str, list[str]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = _LETTERS.findall(text.lower())
                words.update(found)
                own: set[str] = set()
                for w in set(found):
                    if (of := features.get(w)) is None:
                        of = features[w] = word_features(w)
                    own.update(of)
                counts[toxic].update(own)
            trigrams: Counter = Counter()
            for w, times in words.items():
                padded = f"^^{w}$"
                for k in range(len(padded) - 2):
                    trigrams[padded[k : k + 3]] += times
            rows = [(0, f, counts[0][f], counts[1][f]) for f in counts[0].keys() | counts[1].keys()] + [(1, t, m, 0) for t, m in trigrams.items()]
            yield pd.DataFrame(rows, columns=["kind", "feature", "clean", "toxic"])

    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    counted = sample.mapInPandas(count, "kind int, feature string, clean long, toxic long").groupBy("kind", "feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = materialize(counted, "features")
    features = counted.where("kind = 0")
    words = features.where("feature NOT LIKE '^%'").select("feature", (F.col("clean") + F.col("toxic")).alias("n")).where(F.col("n") >= max(LEAST_DOCS, LEXICON_SHARE * (n[0] + n[1])))
    features = features.where(F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * n[1])).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    weights = {r["feature"]: min(MOST_ODDS, r["odds"]) for r in features.collect()}
    trigrams = counted.where("kind = 1").select("feature", F.col("clean").alias("n"))
    model = Model(weights, {r["feature"]: r["n"] for r in trigrams.collect()}, {r["feature"]: r["n"] for r in words.collect()})

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame({"x": [math.log1p(scorer(t)) for t in batch["text"]], "y": batch["toxic"].astype(float)})

    rows = sample.select("text", "toxic").mapInPandas(weigh, "x double, y double").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    model.slope, model.intercept = fit_curve(materialize(rows, "curve"))
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of every document with an id.

    Null and empty texts have no toxic weight and score the curve's least value.
    Repeated rows are scored each; an empty table gives no rows; further columns
    aren't read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": [scorer.score(t or "") for t in batch["text"]]})

    rows = identified(docs, id_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInPandas(run, "id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)
