"""Small tables for the operator tests."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def table(name: str) -> pd.DataFrame:
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'").df()


def docs(spark, rows, extra=True):
    """Documents of (doc_id, text[, lang[, source]]) with columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 7) for r in rows]
    columns = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score int"
    frame = spark.createDataFrame(full, columns)
    return frame if extra else frame.drop("keep_id", "score")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
