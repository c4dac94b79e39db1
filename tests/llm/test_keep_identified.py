import random

from tests.llm.helpers import docs
from timeweave.llm.language_id import keep_identified


def test_short_documents_with_keys_stay_and_noise_goes(spark):
    r = random.Random(5)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "looked", "at", "its", "token"]
    train = [(i, " ".join(r.choice(words) for _ in range(30)), "en") for i in range(80)]
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(32))
    good = [(100, f'the cat sat token = "{key()}" on the mat', None), (101, " ".join(f'token = "2abc{key()}"' for _ in range(3)), None), (102, "A.", None), (103, "a", "en")]
    noise = [(200, "жжж щщщ ыы", None), (201, "xqz wvk jjq zzx qqk", None), (202, "9f3c2b1d8e7a6f5b 77zq9x1v", None), (203, "", "en"), (204, None, None), (205, "12 34", None)]
    kept = {row.doc_id for row in keep_identified(docs(spark, train + good + noise)).collect()}
    assert kept == {row[0] for row in train + good}


def test_all_labelled_rows_of_the_small_table_stay(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert keep_identified(df).count() == df.count()
