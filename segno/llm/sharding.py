"""Balanced contiguous shards from global prefix sums of byte sizes.

Documents stand in one global order: by a hash of the text, so that equal texts are neighbours, and
then by identifier. That order is dealt out by range; each partition's total is taken, the totals'
prefix sums give every partition its start, and the running sum inside a partition does the rest.
Cutting the total at equal targets gives contiguous shards of nearly equal bytes.

The unit that is placed is a group of equal texts, which so never spreads over two shards, unless it
weighs more than ``tolerance`` of a shard, or has that share of its rows: such a group is split by identifier into parts of about
that weight, which are units of their own. No shard is off its target by more than about two units.

Defined results
---------------
* Size is the UTF-8 bytes of the text plus one; a null text has no bytes and counts as empty for its
  checksum and its group.
* ``slot`` numbers the rows of a shard without gaps from 0, in the global order. Rows that repeat
  text and identifier take neighbouring slots in either order.
* An empty table gives no rows. A shard may be empty when there are fewer units than shards.
* Null identifiers are rows like any other and sort first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, settle

#: Rows that a unit may have whatever its share of all rows.
HOT_ROWS = 1000


def prefix_sums(units: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive global prefix sums of columns in the order of ``keys``.

    ``sums`` maps a column to the name of its prefix sum. Only a row per partition meets in one task.
    """
    dealt = settle(units.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for c, n in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums.values()])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(starts), "_part")  # a row for each partition
    return placed.select(*units.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for c, n in sums.items()])


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.02) -> DataFrame:
    """A row per input row: doc_id, size, text_crc32, shard and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    rows = settle(rows)  # about 40 bytes a document; the texts are read once
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    unit, most = max(1, int(total / shards * tolerance)), max(HOT_ROWS, int(n_rows / shards * tolerance))

    # Groups that outweigh a unit, or have as many rows (of empty texts): a few for each shard and unit, whatever the number of rows.
    heavy = rows.groupBy("_text").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n")).where((F.col("_bytes") > unit) | (F.col("_n") > most))
    heavy = heavy.select("_text", F.ceil(F.greatest(F.col("_bytes") / F.lit(unit), F.col("_n") / F.lit(most))).cast("long").alias("_parts"))
    rows = rows.join(F.broadcast(heavy), "_text", "left")
    # Rows without an identifier are dealt out as they come.
    deal = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id"))
    rows = settle(rows.withColumn("_split", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(deal, F.col("_parts")))).drop("_parts"))

    units = rows.groupBy("_text", "_split").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    units = prefix_sums(units, ["_text", "_split"], {"_bytes": "_byte0", "_rows": "_row0"})
    middle = F.col("_byte0") + F.col("_bytes") / 2
    units = settle(units.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int")))
    first = units.groupBy("shard").agg(F.min("_row0").alias("_first"))
    units = units.join(F.broadcast(first), "shard")  # a row for each shard

    nth = F.row_number().over(Window.partitionBy("_text", "_split").orderBy(F.col("doc_id").asc_nulls_first())) - 1
    placed = rows.join(units.select("_text", "_split", "shard", "_row0", "_first"), ["_text", "_split"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_row0") - F.col("_first") + nth).cast("long").alias("slot"))


def sharding_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    return shard_by_bytes(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
