import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SF, table
from timeweave.llm import warc
from timeweave.llm.warc import LoserTree, index_runs, merge_runs, read_records, record, url_key, warc_index, write_archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, run int")


def check(got, rows, least=0):
    payloads = [(p, (h or "").encode()) for p, _, h in rows if p is not None]
    first = {}
    for p, b in payloads:
        first[b] = min(p, first.get(b, p))
    want = sorted((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if len(b) < least or first[b] == p else "revisit", None if len(b) < least or first[b] == p else first[b]) for p, b in payloads)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_edge_cases(spark):
    rows = [(5, "http://B.example/x?q#f", "same é"), (2, "https://a.example/", "same é"), (9, None, None), (7, "::bad\r\nurl", ""), (1, "http://a.example:8080/", "z" * 300_000), (None, "u", "v"), (8, "é", "\r\n\r\n")]
    check(warc_index(pages(spark, rows)).collect(), rows)
    check(warc_index(pages(spark, rows), least_bytes=7).collect(), rows, least=7)
    assert warc_index(pages(spark, [])).count() == 0
    assert warc_index(pages(spark, rows[:3] * 2)).count() == 6
    found = sorted(warc_index(pages(spark, rows[:3] * 2)).collect(), key=lambda r: r.history_position)
    keys = [(r.urlkey, r.ts, r.page_id) for r in found]
    assert keys == sorted(keys) and [r.history_position for r in found] == list(range(6))


def test_global_order_and_archives(spark):
    frame = table("pages")
    df = spark.read.parquet(f"{SF}/pages.parquet")
    archives = write_archives(df)
    names = [r.data for r in archives.collect()]
    assert sum(len(list(read_records(d))) for d in names) == len(frame)
    assert all(gzip.decompress(d).startswith(b"WARC/1.1\r\n") for d in names)
    got = sorted(merge_runs(index_runs(archives), ranges=5).collect(), key=lambda r: (r.history_range, r.position))
    keys = [(r.urlkey, r.ts, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == len(frame)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9))), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("https://Www.Example.com/a?b=1#c") == "com,example,www)/a?b=1"
    assert url_key("http://h:80") == "h)/" and url_key("http://h:81/") == "h:81)/" and url_key("") == "" and url_key("http://[x") == "http://[x"
    assert b"WARC-Type: revisit" in record(3, "u", b"abc", "D", 1) and not record(3, "u", b"abc", "D", 1).rstrip().endswith(b"abc")


def test_records_of_any_size_and_damage(monkeypatch):
    members = [gzip.compress(record(i, f"u{i}", bytes([65 + i]) * n, "D", i), 1, mtime=0) for i, n in enumerate((0, 1, 70_000, 200_000, 5))]
    data = b"".join(members)
    for size in (1, 7, 1 << 16, 1 << 22):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        got = list(read_records(data))
        assert [(o, n) for o, n, *_ in got] == [(sum(map(len, members[:k])), len(m)) for k, m in enumerate(members)]
        assert [h["warc-record-id"] for *_, h, _ in got] == [f"<urn:x-page:{i}>" for i in range(5)] and got[3][3].endswith(b"D" * 200_000)
    with pytest.raises(ValueError, match="cut record"):
        list(read_records(data[:-9]))


def test_query_against_sql(spark):
    from timeweave.llm.queries import op1_warc_index

    got = op1_warc_index(spark, SF).toPandas().sort_values("page_id", ignore_index=True)
    pages_view = duckdb.connect()
    pages_view.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = pages_view.execute(warc.ORACLE_SQL).df().sort_values("page_id", ignore_index=True)[list(got.columns)]
    assert got.astype(object).where(got.notna(), None).equals(want.astype(object).where(want.notna(), None))
