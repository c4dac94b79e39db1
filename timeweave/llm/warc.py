"""WARC archives of pages, and an index merged from locally sorted capture runs.

Writing: records of one payload keep it once, in the response with the smallest
page_id; the others are revisits that refer to it. Reading: each archive gives a
run of captures sorted by URL key and timestamp. Sampled splitters cut the runs
into slices, and a loser tree merges the slices of a key range, which yields
globally ordered capture histories.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import pickle
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import materialize, partitions, per_group

#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 8 << 20
#: Bytes that a reader takes at once, and index rows that a merge gives at once.
READ_BYTES, MERGED_ROWS = 1 << 16, 10_000
#: Keys a range in the bounded sample from which splitters are taken.
SAMPLE_PER_RANGE = 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
INDEX = "run string, urlkey string, ts string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, offset long, length long"


def url_key(url: str) -> str:
    """The sort-friendly form: host labels reversed, then path and query; a null or odd URL keeps its text."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    name = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def base32_digest(hex_digest: str) -> str:
    """A SHA-1 in base32, as archives note it."""
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int, url: str, payload: bytes, digest: str, first: int) -> bytes:
    """One WARC/1.1 record; a revisit if ``first``, the page that holds the payload, is another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    date = (EPOCH + datetime.timedelta(seconds=page_id % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    uri = "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first == page_id else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    block = http
    if first == page_id:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{first}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, data): gzip members, one a record, of about ARCHIVE_BYTES an archive, in the shared folder.

    Payloads of at least ``least_bytes`` that are equal are stored once. A null
    page is an empty payload, a null URL an empty one; rows without an id can't
    be referred to and are left out.
    """
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    # Only payloads that several pages have are looked up: one row a revisit, without the payloads.
    small = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest").distinct()
    first = per_group(small, ["digest"], "page_id", {"first": ("min", "page_id")}).where("first <> page_id")
    both = rows.join(first, ["page_id", "digest"], "left").withColumn("first", F.coalesce("first", "page_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out = None, io.BytesIO()
        for batch in batches:
            for page_id, url, html, digest, holder in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["first"]):
                name = f"page-{page_id}" if name is None else name
                out.write(gzip.compress(record(int(page_id), url, html.encode("utf-8", "replace"), base32_digest(digest), int(holder)), 1, mtime=0))
                if out.tell() >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [name], "data": [out.getvalue()]})
                    name, out = None, io.BytesIO()
        if name is not None:
            yield pd.DataFrame({"archive": [name], "data": [out.getvalue()]})

    return materialize(both.mapInPandas(run, "archive string, data binary"), "warc")


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each gzip member of an archive, fed in chunks of READ_BYTES."""
    view, at = memoryview(data), 0
    while at < len(data):
        member, out, end = zlib.decompressobj(31), [], at
        while not member.eof:
            if end >= len(data):
                raise ValueError(f"cut record at {at}")
            chunk = view[end : end + READ_BYTES]
            out.append(member.decompress(chunk))
            end += len(chunk) - len(member.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        yield at, end - at, headers, rest[: int(headers["content-length"])]
        at = end


def _page(uri: str) -> int:
    return int(uri.strip("<>").rpartition(":")[2])


def capture(run: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index row of a record; a response's payload is checked against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged payload in {run} at {offset}")
    refers = _page(headers["warc-refers-to"]) if kind == "revisit" else None
    return (run, url_key(headers["warc-target-uri"]), headers["warc-date"], _page(headers["warc-record-id"]), kind, digest, size, refers, offset, length)


def index_runs(archives: DataFrame) -> DataFrame:
    """INDEX rows; each archive is a run whose rows come sorted by (urlkey, ts, page_id)."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["archive"], batch["data"]):
                rows = sorted((capture(archive, *x) for x in read_records(data)), key=lambda r: r[1:4])
                frame = pd.DataFrame(rows, columns=names)
                yield frame.assign(refers_to=frame["refers_to"].astype("Int64"))

    return archives.mapInPandas(run, INDEX)


class LoserTree:
    """k-way merge of sorted iterables: inner nodes hold losers, so a step replays one path to the root."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int, filling: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and filling:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            yield head
            winner = self.losers[0]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def merge_runs(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """INDEX rows with history_range and position: their order is that of (urlkey, ts, page_id) over all runs.

    ``index`` is read twice, so it should be a written table. Equal keys keep the
    order of their runs. An empty index gives no rows.
    """
    n = ranges or partitions(index.sparkSession)
    key = F.struct("urlkey", "ts", "page_id")
    sample = sorted(tuple(r["key"]) for r in index.select(key.alias("key"), F.xxhash64("urlkey", "page_id").alias("h")).orderBy("h").limit(SAMPLE_PER_RANGE * n).select("key").collect())
    splitters = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    columns = [c.split()[0] for c in INDEX.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect

        for batch in batches:
            out: dict[tuple[int, str], list[tuple]] = {}
            refers = [None if pd.isna(x) else int(x) for x in batch["refers_to"]]
            for row in zip(*[refers if c == "refers_to" else batch[c] for c in columns]):
                out.setdefault((bisect.bisect_right(splitters, row[1:4]), row[0]), []).append(row)
            # Runs come sorted, so do their slices; equal keys go by what they refer to.
            yield pd.DataFrame({"history_range": [k[0] for k in out], "run": [k[1] for k in out], "slice": [zlib.compress(pickle.dumps([r[1:4] + (-1 if r[7] is None else r[7],) + r for r in sorted(rows, key=lambda r: r[1:4])]), 1) for rows in out.values()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def slice_rows(data: bytes) -> Iterator[tuple]:
            yield from pickle.loads(zlib.decompress(data))

        def merged(number: int, slices: list[bytes]) -> Iterator[pd.DataFrame]:
            tree, position = iter(LoserTree(map(slice_rows, slices))), 0
            while rows := [x[4:] for x in islice(tree, MERGED_ROWS)]:
                frame = pd.DataFrame(rows, columns=columns)
                yield frame.assign(refers_to=frame["refers_to"].astype("Int64"), history_range=np.int32(number), position=np.arange(position, position + len(rows)))
                position += len(rows)

        number, slices = None, []
        for batch in batches:
            for at, part in zip(batch["history_range"], batch["slice"]):
                if at != number and slices:
                    yield from merged(number, slices)
                    slices = []
                number = at
                slices.append(part)
        if slices:
            yield from merged(number, slices)

    slices = index.mapInPandas(cut, "history_range int, run string, slice binary")
    return slices.repartition(n, "history_range").sortWithinPartitions("history_range", "run").mapInPandas(merge, INDEX + ", history_range int, position long")


def global_positions(merged: DataFrame) -> DataFrame:
    """``merged`` with ``history_position``, the place in the order of all ranges; it should be a written table.

    The ranges' row counts, one row a range, tell where each begins.
    """
    counts = sorted((r["history_range"], r["n"]) for r in merged.groupBy("history_range").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in counts]]).tolist()
    table = merged.sparkSession.createDataFrame([(k, at) for (k, _), at in zip(counts, starts)], "history_range int, _start long")
    return merged.join(F.broadcast(table), "history_range").withColumn("history_position", F.col("_start") + F.col("position")).drop("_start")


def warc_index(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives of ``pages``, read them back, merge their index: one row a page with an id.

    ``history_position`` is the place in the global order of (urlkey, ts,
    page_id), from 0. Repeated rows each get a record and a place; an empty table
    gives no rows; further columns aren't read.
    """
    archives = write_archives(pages, least_bytes, id_col, url_col, html_col)
    return global_positions(materialize(merge_runs(materialize(index_runs(archives), "cdx")), "histories"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS b FROM pages WHERE page_id IS NOT NULL),
     d AS (SELECT page_id, url, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM p),
     bits AS (SELECT *, list_transform(range(32), lambda i: CAST('0x' || substr(hex, CAST(i * 5 // 4 AS INTEGER) + 1, 2) || '0' AS BIGINT)) AS w FROM d),
     parts AS (SELECT *, regexp_extract(url, '^https?://([^/?#:]*)(:[0-9]+)?(/[^?#]*)?([?][^#]*)?', ['host', 'port', 'path', 'query']) AS u FROM bits),
     keyed AS (SELECT *, array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || CASE WHEN u.port IN ('', ':80', ':443') THEN '' ELSE u.port END
                      || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN u.query = '?' THEN '' ELSE u.query END AS urlkey,
                      strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM parts)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((w[CAST(i + 1 AS INTEGER)] >> CAST(7 - i * 5 % 4 AS INTEGER)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
       urlkey, ts, row_number() OVER (ORDER BY urlkey, ts, page_id) - 1 AS history_position
FROM keyed
"""
