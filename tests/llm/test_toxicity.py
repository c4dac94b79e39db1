import itertools
import math
import random
import zlib

from pyspark.sql import functions as F

from tests.llm.helpers import collected, docs
from timeweave.llm import toxicity
from timeweave.llm.common import id_crc
from timeweave.llm.toxicity import SEPARATORS, UNKNOWN, CharacterModel, Lexicon, Model, Scorer, lattice, learn, options, restore, score_documents, segment, spaced_words, word_features


def labels(spark, rows):
    return spark.createDataFrame([(d, 1, t, "x") for d, t in rows], "doc_id long, quality int, toxic int, text string")


def trigrams(*words):
    out = {}
    for w in words:
        p = f"^^{w}$"
        for k in range(len(p) - 2):
            out[p[k : k + 3]] = out.get(p[k : k + 3], 0) + 1
    return out


def test_restoring():
    model = CharacterModel(trigrams(*["loser", "moron", "stupid", "good", "hello", "all"] * 5))
    for token, word in (("l0s3r", "loser"), ("m.o.r.o.n", "moron"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("looooser", "loser"), ("5-t-u-p-!-d", "stupid")):
        assert restore(token, model) == word
    assert lattice("hello") is None and lattice("") is None and lattice("12") is None and lattice("a%b") is None and len(lattice("x" * 41)) == 41
    assert spaced_words("you l 0 s e r go a b".split()) == ["l0ser"]


def test_learning_scoring_and_disguise(spark):
    clean = "the quick brown fox jumps over a lazy dog and runs along the river"
    rows = [(i, f"{clean} you scum and loser number{i}x" if i % 4 == 0 else f"{clean} number{i}x") for i in range(400)]
    marks = [(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (9999, 1)]
    more = [(1000, f"{clean} you 5cum and l0ser"), (1001, f"{clean} you s c u m and looooser"), (1002, None), (1003, ""), (1004, clean * 500), (1005, f"{clean} 1O:30 $5.00 a b c 1.2.3.4")]
    df = docs(spark, rows + more)
    got = collected(score_documents(df, learn(df, labels(spark, marks))))
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, f"w{i} common text") for i in range(200)]
    df = docs(spark, rows)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    a, b = (learn(df, labels(spark, [(i, (i % 2) if i not in held else flip) for i in range(200)])) for flip in (0, 1))
    assert a == b and df.where(id_crc(df.doc_id) % 3 == 1).count() == len(held)


def test_nothing_learned_or_empty(spark):
    df = docs(spark, [(1, "a b"), (2, None)])
    model = learn(df, labels(spark, []))
    assert model == Model() and {r.predicted for r in score_documents(df, model).collect()} == {0}
    assert score_documents(docs(spark, []), model).count() == 0


def word_cost(word, model):
    """ln of the probability that the character model gives a whole word."""
    padded = f"^^{word}$"
    return sum(model.cost(padded[k : k + 2], padded[k + 2]) for k in range(len(word) + 1))


def all_restored(token, model):
    """Every path of the lattice, one by one: the words of the highest total."""
    found = {}
    for path in itertools.product(*lattice(token)):
        word = "".join(letter for letter, _ in path)
        found[word] = max(found.get(word, -math.inf), sum(c for _, c in path) + word_cost(word, model))
    best = max(found.values())
    return {w for w, total in found.items() if total > best - 1e-9}


def all_segmented(token, model, lexicon, anywhere):
    """Every choice of letters and word ends, one by one: the readings of the highest total."""
    found = {}

    def price(word):
        spelled = UNKNOWN + word_cost(word, model)
        return max(spelled, lexicon.cost.get(word, -math.inf))

    def go(k, total, done, word):
        if k == len(token):
            reading, total = (*done, word) if word else done, total + (price(word) if word else 0.0)
            found[reading] = max(found.get(reading, -math.inf), total)
            return
        choices = options(token, k)
        if choices is None:
            go(k + 1, total + (price(word) if word else 0.0), (*done, word) if word else done, "")
            return
        for letter, cost in choices:
            go(k + 1, total + cost, done, word + letter)
            if word + letter and (anywhere or token[k] in SEPARATORS):
                go(k + 1, total + cost + price(word + letter), (*done, word + letter), "")

    go(0, 0.0, (), "")
    best = max(found.values())
    return {r for r, total in found.items() if total > best - 1e-9}


def test_viterbi_against_every_path():
    r = random.Random(2)
    model = CharacterModel(trigrams(*["loser", "moron", "stupid", "good", "hello", "all", "a", "i", "as"] * 3))
    lexicon = Lexicon({"loser": 5, "a": 40, "as": 9, "all": 3, "good": 7, "so": 2})
    tokens = ["l0s3r", "as|ol", "go.od", "1.0.s.e.r"] + ["".join(r.choice("aolsgd01$.-!") for _ in range(r.randint(1, 7))) for _ in range(150)]
    for token in tokens:
        if lattice(token) is not None:
            want = all_restored(token, model)
            assert (restore(token, model) or "") in want, token
        for anywhere in (False, True):
            assert tuple(segment(token, model, lexicon, anywhere)) in all_segmented(token, model, lexicon, anywhere), token
    assert tuple(segment("as%good", model, lexicon, True)) in all_segmented("as%good", model, lexicon, True)


def test_scores_against_brute_force(spark):
    """A text's score, from the weights of the plain, restored and segmented forms of its tokens, one by one."""
    weights = {"idiot": 5.0, "^scum": 3.0, "loser": 2.5, "^lose": 1.0}
    words = {"idiot": 4, "you": 90, "are": 80, "an": 70, "scum": 3, "loser": 4, "the": 99}
    model = Model(weights, trigrams(*words, "scummy"), words, 1.7, -2.0)
    letters, lexicon = CharacterModel(model.trigrams), Lexicon(words)
    texts = ["you are an idiot", "1d10t !!", "i d i o t", "y o u s c u m", "l.o.s.e.r x", "scummy (l0ser)", "the 12:30 $5", "", None, "iiiidiot", "IDIOT scums"]

    def weight(text):
        of_word = lambda w: max([weights.get(f, 0.0) for f in word_features(w)], default=0.0)
        total, tokens = 0.0, text.lower().split()
        for token in tokens:
            forms = [sum(of_word(w) for w in toxicity._LETTERS.findall(token))]
            core = token.strip("\"'()[]{}<>?,;:.*#%&~`^-_/\\=")
            for form in {core, core.rstrip("!")}:
                if lattice(form) is not None:
                    restored = all_restored(form, letters)
                    assert len(restored) == 1
                    forms.append(of_word(*restored))
                    if set(form) & SEPARATORS:
                        forms.append(max(sum(map(of_word, x)) for x in all_segmented(form, letters, lexicon, False)))
            total += max(forms)
        for run in spaced_words(tokens):
            readings = [[run], *all_segmented(run, letters, lexicon, True), *([w] for w in (all_restored(run, letters) if lattice(run) else ()))]
            total += max(sum(map(of_word, x)) for x in readings)
        return total

    got = collected(score_documents(docs(spark, list(enumerate(texts))), model))
    for k, text in enumerate(texts):
        want = 1 / (1 + math.exp(-(-2.0 + 1.7 * math.log1p(weight(text or "")))))
        assert abs(got[k].score - want) < 1e-12 and got[k].predicted == int(want >= 0.7), text
    assert got[0].predicted == got[2].predicted == 1 and got[6].predicted == 0


def test_long_disguises_are_decoded():
    scorer = Scorer(Model({"idiot": 5.0}, trigrams("idiot", "you", "are"), {"idiot": 4, "you": 9, "are": 9}, 1.0, 0.0))
    assert scorer("i d i o t") == 5.0 and scorer(" ".join(["i d i o t"] * 9)) >= 5.0
    assert scorer("1" + "-" * 40 + "d!0t") == 5.0 and scorer("1" + "d" * 300 + "!0t") == 5.0


def test_equal_texts_with_different_labels_are_one_toxic_row(spark):
    rows = [(i, ["same text", "other text"][i % 2]) for i in range(40)]
    sample = toxicity.training_sample(docs(spark, rows), labels(spark, [(i, int(i == 0 or i == 4)) for i in range(40)]), "doc_id", "text", "toxic")
    marked = [i for i in (0, 4) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert marked and {(r.text, r.toxic) for r in sample.collect()} == {("same text", 1), ("other text", 0)}


def test_all_labelled_documents_are_learned_from(spark):
    """More of either class than a sample of 2,500 and 5,000 would hold."""
    rows = [(i, f"plain words number {'abcdefgh'[i % 8]} vilest" if i % 4 == 0 else "plain words of others") for i in range(13_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    several = frame.withColumn("text", F.concat("text", F.lit(" "), F.translate(F.col("doc_id").cast("string"), "0123456789", "qwertyuiop")))
    marks = labels(spark, [(i, int(i % 4 == 0)) for i in range(13_000)])
    sample = toxicity.training_sample(several, marks, "doc_id", "text", "toxic")
    want = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sample.count() == len(want) > 7500
    assert toxicity.learn(several, marks).words["plain"] == len(want)


def test_the_curve_has_the_least_penalised_loss(spark):
    points = [(0.0, 0.0, 50), (0.0, 1.0, 3), (1.0, 0.0, 5), (1.5, 1.0, 9), (2.0, 1.0, 20), (3.0, 1.0, 4)]
    a, b = toxicity.fit_curve(spark.createDataFrame(points, "x double, y double, n long"))
    loss = lambda a, b: sum(n * (math.log1p(math.exp(a * x + b)) - y * (a * x + b)) for x, y, n in points) + 0.05 * a * a + 0.0005 * b * b
    assert all(loss(a, b) < loss(a + da, b + db) for da, db in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))
