import random
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_tokens_against_brute_force(spark):
    from timeweave.operators.alignment import near_tokens

    r = random.Random(4)
    words = {"".join(r.choice("abc") for _ in range(r.randint(3, 11))) for _ in range(250)} | {"kitten", "mitten", "sitting", "x" * 40, "y" + "x" * 39}
    words |= {w[1:] for w in list(words)[:60]} | {"z" + w for w in list(words)[:60]}
    want = {(a, b) for a in words for b in words if a < b and (n := min(len(a), len(b))) > 4 and distance(a, b) <= (1 if n <= 7 else 2)}
    got = near_tokens(spark.createDataFrame([(w,) for w in words], "w string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want and ("kitten", "mitten") in want


def test_tokens_about_the_length_from_which_they_meet_at_pieces(spark):
    from timeweave.operators.alignment import MOST_LEFT_OUT, near_tokens

    r = random.Random(5)
    words = set()
    for n in range(6, MOST_LEFT_OUT + 6):
        w = "".join(r.choice("abé") for _ in range(n))
        words |= {w, w[1:], w[:-2], w[: n // 2] + "x" + w[n // 2 :], "y" + w[1:-1] + "z", w[2:] + "q"}
    want = {(a, b) for a in words for b in words if a < b and (n := min(len(a), len(b))) > 4 and distance(a, b) <= (1 if n <= 7 else 2)}
    got = near_tokens(spark.createDataFrame([(w,) for w in words], "w string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want and len(want) > 100


def test_what_is_left_of_tokens_is_not_sent_to_the_driver(spark, tmp_path):
    from timeweave.operators.alignment import MOST_LEFT_OUT, near_tokens

    r = random.Random(6)
    words = {"".join(r.choice("abcd") for _ in range(r.choice([6, 9, MOST_LEFT_OUT + 4]))) for _ in range(200)}
    words |= {w[:-1] + "z" for w in words}
    spark.createDataFrame([(w,) for w in words], "w string").write.parquet(f"{tmp_path}/words")
    found = near_tokens(spark.read.parquet(f"{tmp_path}/words"))
    got = {tuple(x) for x in found.collect()}
    assert all((min(w, o), max(w, o)) in got for w in words if (o := w[:-1] + "z") != w)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
