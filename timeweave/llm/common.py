"""What the training-data operators share: scratch tables, salting, text keys."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.session import own_folder

#: Bytes of an Arrow batch on its way to a Python worker, where ``small_batches`` holds.
BATCH_BYTES = 4 << 20
#: glibc's numbers of M_TRIM_THRESHOLD and M_MMAP_THRESHOLD.
_TRIM, _MMAP = -1, -3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage and survives the loss of executors; the files go when
    the application ends.
    """
    path = own_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within goes to Python in batches of about BATCH_BYTES, one row at least.

    Spark's own limit is 10,000 rows, which are tens of MB of texts or packed
    tables: they are held several times, in the JVM's buffers beyond its heap
    and in the worker. Plans take the limit when they run, so what a caller is to
    run later is written within.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def in_small_batches(function: Callable) -> Callable:
    """``function`` of a table first, within ``small_batches``."""

    @functools.wraps(function)
    def run(docs: DataFrame, *args, **kwargs):
        with small_batches(docs.sparkSession):
            return function(docs, *args, **kwargs)

    return run


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a task, after which its worker, which waits for the next task, gives freed memory back.

    Arrays of 1 MB and more are mapped each; glibc otherwise raises that limit to
    32 MB as they are freed, and keeps what lies below the last one.
    """

    @functools.wraps(run)
    def of_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        libc = ctypes.CDLL(None)
        if mallopt := getattr(libc, "mallopt", None):
            mallopt(_MMAP, 1 << 20)
            mallopt(_TRIM, 1 << 20)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(libc, "malloc_trim", None):
                trim(0)

    return of_task


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a column: one narrow scan, one row to the driver."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])


def blocks_for(size: int, block: int, least: int = 1) -> int:
    """How many blocks of about ``block`` bytes hold ``size`` bytes."""
    return max(least, math.ceil(size / block))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and only those, in lower case.

    A text with as many bytes as characters is plain ASCII, where ``lower`` does
    just that and faster.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of an identifier written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def _salted(rows: DataFrame, spread: str) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(max(16, partitions(rows.sparkSession)))).cast("int"))


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key.

    A key that a third of all rows have is spread by the hash of ``spread``: the
    table's row is copied to the sub-groups that exist, and rows meet it there.
    """
    salted = _salted(rows, spread)
    copies = salted.select(*keys, "_salt").distinct().join(table, list(keys))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def per_group(rows: DataFrame, keys: Sequence[str], spread: str, values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with aggregates of their group, for groups of any size.

    ``values`` maps an output name to ("min" | "max" | "sum" | "count", column).
    The rows of a group are spread over sub-groups by the hash of ``spread``:
    they are aggregated there with map-side combine, the sub-groups' results are
    combined (as many as there are partitions at most) and go back to the
    sub-groups. No task gets a group as a whole. Keys mustn't be null.
    """
    salted = _salted(rows, spread)
    first = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max}
    second = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    heads = salted.groupBy(*keys, "_salt").agg(*[first[kind](column).alias(name) for name, (kind, column) in values.items()])
    groups = heads.groupBy(*keys).agg(*[second[kind](name).alias(name) for name, (kind, _) in values.items()])
    back = heads.select(*keys, "_salt").join(groups, list(keys))
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def identified(docs: DataFrame, id_col: str) -> DataFrame:
    """The rows with an id; a document without one can't be referred to, and no operator returns it."""
    return docs.where(F.col(id_col).isNotNull())


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others with clashing names can't get in the way."""
    return docs.select(*[F.col(c) for c in columns])
