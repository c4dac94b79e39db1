"""Exact deduplication by content sort (native: DataFrame operations only).

Sampled splitters deal the normalised bytes out by range, an external sort puts
equal texts next to each other, and each text is compared in full with its
neighbour: a run ends where they differ, and the identifier that stays is carried
along the run.

The splitters have the first characters of a text and its digest instead of the
rest, so that their sample on the driver is small. The digest decides where a
text goes, never which texts are equal: texts of one digest are told apart by the
comparisons. A digest that many rows have is salted, so that its rows go to many
tasks; there can be SHARE for each partition at most, so their table is small.
The first row of each of its runs meets those of the other salts afterwards, is
compared in the same way, and the runs of equal texts are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import UPPER, ascii_lower, identified, materialize, partitions, plain

#: Characters of the text in the splitters; the comparison is of whole texts.
SPLITTER_CHARS = 32
#: A digest is salted from the SHARE-th part of a partition's mean rows on.
SHARE = 4


def _digest(text: Column) -> Column:
    """What stands for the rest of a text in the order of the range partitions."""
    return F.sha2(text, 256)


def _starts(key: list[str]) -> Column:
    """1 where a text differs from the one before it in the sorted rows of ``key``, else 0; and so on the first."""
    before = F.lag("_text").over(Window.partitionBy(*key).orderBy("_text", "_id"))
    return F.when(before == F.col("_text"), 0).otherwise(1)


def sort_runs(docs: DataFrame, keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, text_sha256, _head, _deal, _salt, _run, _keep, _size, _salts, _text) of every row with an id, written.

    ``_run`` numbers the runs of equal texts in the sorted rows of a (_head,
    _deal, _salt), which are in one task; ``_keep`` and ``_size`` are those of the
    run. ``_text`` is there on the first row of runs of salted digests.
    """
    n = partitions(docs.sparkSession)
    best = F.max if keep == "largest" else F.min
    rows = plain(identified(docs, id_col), id_col, text_col).select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    rows = rows.withColumn("_deal", _digest(F.col("_text")))
    counts = materialize(rows.groupBy("_deal").agg(F.count(F.lit(1)).alias("_n")), "digests")
    share = F.broadcast(counts.agg((F.sum("_n") / (SHARE * n)).alias("_share")))
    # More rows than the share: SHARE * n digests at most.
    hot = counts.where("_n > 1").join(share, F.col("_n") > F.col("_share")).select("_deal", F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_salts"))
    rows = rows.join(F.broadcast(hot), "_deal", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    rows = rows.select("_id", "_text", F.substring("_text", 1, SPLITTER_CHARS).alias("_head"), "_deal", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int").alias("_salt"), "_salts")
    key = ["_head", "_deal", "_salt"]
    marked = rows.repartitionByRange(n, *key).withColumn("_starts", _starts(key))
    ordered = Window.partitionBy(*key).orderBy("_text", "_id")
    numbered = marked.withColumn("_run", F.sum("_starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.select("_id", *key, "_run", "_salts", F.sha2("_text", 256).alias("text_sha256"), F.when((F.col("_salts") > 1) & (F.col("_starts") == 1), F.col("_text")).alias("_text"))
    run = Window.partitionBy(*key, "_run")
    return materialize(numbered.withColumn("_keep", best("_id").over(run)).withColumn("_size", F.count(F.lit(1)).over(run)), "runs")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row a document with an id: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the smallest (or ``keep="largest"``) identifier
    stays. Rows that repeat an identifier with the same text count in
    ``group_size`` and share its decision. Rows without an identifier are left
    out. An empty table gives no rows; further columns of ``docs`` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    best = F.max if keep == "largest" else F.min
    runs = sort_runs(docs, keep, id_col, text_col)
    # One row a run of each salt: texts of one digest meet here.
    key = ["_head", "_deal"]
    first = runs.where("_text IS NOT NULL").select(*key, "_salt", "_run", "_text", F.col("_keep").alias("_id"), "_size").withColumn("_starts", _starts(key))
    ordered = Window.partitionBy(*key).orderBy("_text", "_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = first.withColumn("_whole", F.sum("_starts").over(ordered))
    whole = Window.partitionBy(*key, "_whole")
    met = joined.select("_deal", "_head", "_salt", "_run", best("_id").over(whole).alias("_all"), F.sum("_size").over(whole).alias("_total"))
    found = runs.drop("_text").join(F.broadcast(met), [*key, "_salt", "_run"], "left")
    found = found.select(F.col("_id").alias(id_col), F.coalesce("_all", "_keep").alias("keep_id"), F.coalesce("_total", "_size").alias("group_size"), "text_sha256")
    return found.select(id_col, "keep_id", "group_size", (F.col(id_col) == F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows without an id go; of rows that repeat an id all stay if one of their
    texts does.
    """
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col] == kept["_kept_id"], "left_semi")


ORACLE_SQL = f"""
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents WHERE doc_id IS NOT NULL)
"""
