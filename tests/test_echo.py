"""The echo passes on literal words and levels."""

import math
import random

from timeweave.operators import echo as E

WORD = "session_id long, source string, word_id long, start_ms long, end_ms long, text string"
SPAN = "session_id long, start_ms long, end_ms long"


def phrase(session, source, first_id, start, text, step=300):
    return [(session, source, first_id + k, start + k * step, start + k * step + 200, t) for k, t in enumerate(text.split())]


def marks(df):
    return {(r.session_id, r.word_id): r["pass"] for r in df.collect()}


def test_phrases_break_at_gaps_and_length(spark):
    words = [(1, 1, 0, 100, "a"), (1, 2, 1000, 1100, "b"), (1, 3, 2001, 2100, "c"), (1, 4, 2200, 14_001, "d"), (1, 5, 14_100, 14_200, "e"), (2, 6, 14_300, 14_400, "f")]
    got = E.with_phrases(spark.createDataFrame(words, "session_id long, word_id long, start_ms long, end_ms long, text string"))
    assert {r.word_id: r.phrase for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 0}


def test_texts_alone(spark):
    said = "please send the report before Friday"
    words = phrase(1, "system", 100, 1000, said) + phrase(1, "mic", 200, 1300, "please send the repord before friday")  # the same with a slip, 300 ms later
    words += phrase(2, "system", 100, 1000, said) + phrase(2, "mic", 200, 3000, said)  # too late
    words += phrase(3, "system", 100, 1000, said) + phrase(3, "mic", 200, 1300, said)  # in the room
    words += phrase(4, "system", 100, 1000, "yes no yes") + phrase(4, "mic", 200, 1100, "yes no yes")  # too few
    rows, none = spark.createDataFrame(words, WORD), spark.createDataFrame([], SPAN)
    room = spark.createDataFrame([(3, 1200, 9000)], SPAN)
    assert marks(E.echo_words(rows, room, none)) == {(1, 200 + k): "text" for k in range(6)}


def test_passes_see_what_is_marked(spark):
    r = random.Random(2)
    level = [0.02 + 0.2 * abs(math.sin(k / 7)) * r.random() for k in range(1200)]
    frames = [(1, "system", k, x) for k, x in enumerate(level)] + [(1, "mic", k + 20, x * 0.3) for k, x in enumerate(level)]
    words = phrase(1, "system", 100, 1000, "we could meet on Monday") + phrase(1, "mic", 200, 1200, "we could meet on monday")
    words += phrase(1, "mic", 300, 6000, "alpha beta gamma delta") + phrase(1, "mic", 400, 9000, "one two three")
    # Levels mark 300, 301 and 303; 302 is explained and lies between; 400 is louder than its echo.
    evidence = [(1, 300, 0.1, 0.9), (1, 301, 0.7, 0.75), (1, 302, 0.5, 0.1), (1, 303, 0.2, 0.8), (1, 400, 0.9, 0.9)]
    leads = [(1, f, "system" if f % 10 < 8 else "mic") for f in range(900, 920)] + [(1, f, "system" if f % 2 else "mic") for f in range(930, 950)] + [(1, f, "system") for f in range(960, 964)]
    rows, none = spark.createDataFrame(words, WORD), spark.createDataFrame([], SPAN)
    levels, by_word, led = spark.createDataFrame(frames, "session_id long, source string, frame long, rms double"), spark.createDataFrame(evidence, "session_id long, word_id long, excess double, correlation double"), spark.createDataFrame(leads, "session_id long, frame long, lead string")
    voices = spark.createDataFrame([(1, 9300, 9500)], SPAN)
    got = marks(E.echo_words(rows, none, voices, by_word, levels, led))
    # 400 is led by the system in 8 of 10 frames, 401 in half, which will do for a voice like a remote one, 402 has too few frames.
    assert got == {(1, 200 + k): "text_audio" for k in range(5)} | {(1, 300 + k): "audio" for k in range(4)} | {(1, 400): "lead", (1, 401): "lead"}
    assert (1, 401) not in marks(E.echo_words(rows, none, none, by_word, levels, led))
    quiet = levels.where("source = 'system'").unionByName(levels.where("source = 'mic'").withColumn("rms", levels.frame % 7 / 10.0))
    assert not any(v == "text_audio" for v in marks(E.echo_words(rows, none, none, None, quiet)).values())


def test_passes_are_stored(spark):
    """What the passes mark is not computed again by those that read it."""
    words = spark.createDataFrame(phrase(1, "system", 100, 1000, "we could meet on Monday") + phrase(1, "mic", 200, 1200, "we could meet on monday"), WORD)
    none = spark.createDataFrame([], SPAN)
    evidence = spark.createDataFrame([(1, 300, 0.1, 0.9)], "session_id long, word_id long, excess double, correlation double")
    found = E.echo_words(words, none, none, evidence)
    assert marks(found) == {(1, 200 + k): "text" for k in range(5)} and "Join" not in found._jdf.queryExecution().toString()
