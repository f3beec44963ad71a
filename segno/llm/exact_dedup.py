"""Exact deduplication by content sort.

Sampled splitters deal the rows out by range over a short key of the normalised text (its first
characters, then a 64-bit hash of all of it, so that texts with a common beginning do not meet in one
range and splitters stay small); within each range an external sort places equal texts side
by side, and each row is compared in full with its neighbour. Texts whose hash is very common are
not sorted: their copies are combined before the shuffle, by full text, so that no task receives a
whole large group.

Defined results
---------------
* A null text counts as empty, so null and empty texts are equal.
* Of equal texts the row with the largest identifier stays (``keep="max"``) or the smallest
  (``keep="min"``). A null identifier ranks below all others. Of rows that repeat both text and
  that identifier exactly one stays.
* An empty table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes that more rows than this share are combined before the shuffle.
HOT_ROWS = 256
#: No more hashes than this can count as hot, whatever the number of rows; it bounds the broadcast.
MOST_HOT = 65_536


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise, carry: bool) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if carry else []
    return docs.select(docs[id_col].cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"), *row)


def _ranked(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise, carry: bool) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col, normalise, carry)
    best = F.max if keep == "max" else F.min
    order: Column = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    rest = ["_row"] if carry else []

    hashes = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    total = docs.count()
    limit = max(HOT_ROWS, -(-total // MOST_HOT))
    hot = F.broadcast(hashes.where(F.col("_n") > limit).select("_hash"))  # at most MOST_HOT rows of 8 bytes

    # Common texts: combined on the map side, then looked up. At most one row for each hot text.
    common = keyed.join(hot, "_hash", "left_semi")
    groups = common.groupBy("_text").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = groups.select(F.sha2("_text", 256).alias("_sha"), "_keep", "_size")
    # One row of those that repeat the kept identifier; a handful at most for sound identifiers.
    common = common.withColumn("_sha", F.sha2("_text", 256)).drop("_text", "_hash").join(F.broadcast(groups), "_sha")
    by_row = Window.partitionBy("_sha", "_id").orderBy(F.lit(1))
    common = common.withColumn("_nth", F.row_number().over(by_row))

    # All other texts: range partitioning, external sort, comparison with the neighbour.
    rare = keyed.join(hot, "_hash", "left_anti").withColumn("_head", F.substring("_text", 1, 64))
    rare = rare.repartitionByRange("_head", "_hash")
    beside = Window.partitionBy("_head", "_hash").orderBy("_text", order)
    rare = rare.withColumn("_before", F.lag("_text").over(beside))
    rare = rare.withColumn("_first", F.when(F.col("_before") == F.col("_text"), 0).otherwise(1))
    rare = rare.withColumn("_run", F.sum("_first").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    rare = rare.withColumn("_sha", F.sha2("_text", 256)).drop("_text", "_before", "_first")
    run = Window.partitionBy("_head", "_hash", "_run")
    rare = (
        rare.withColumn("_nth", F.row_number().over(run.orderBy(order)))
        .withColumn("_keep", F.first("_id").over(run.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_size", F.count(F.lit(1)).over(run))
    )
    # In a run the first row in order is the one that stays; equal identifiers stand together.
    rare = rare.withColumn("_nth", F.when(F.col("_nth") == 1, 1).otherwise(2))
    columns = ["_id", "_keep", "_size", "_nth", "_sha", *rest]
    return rare.select(*columns).unionByName(common.select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None) -> DataFrame:
    """A row per input row: its identifier, that of the row that stays, the group's size and digest."""
    ranked = _ranked(docs, id_col, text_col, keep, normalise, carry=False)
    return ranked.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None) -> DataFrame:
    """The rows that stay, with all their columns."""
    ranked = _ranked(docs, id_col, text_col, keep, normalise, carry=True)
    kept = ranked.where(F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1))
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
