"""State that outlives a stage, in the folder that the driver and all executors share, and joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key beyond which it can be hot, and how many keys can be hot at most.
HOT_ROWS, MOST_HOT = 1000, 10_000
#: Spark's setting for shuffle files to go when a query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a session on one machine may go without it, as in tests; it then gets a folder of its own.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="segno-checkpoint-")
    if held.isEmpty():
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as soon as it ends, not when the driver collects its garbage.

    For queries that write their result and are not run again.
    """
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of which later steps read the columns they need."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The rows of ``left`` with the columns of the row of ``right`` that has their keys; nulls equal nulls.

    ``right`` has every key once, with the number ``n`` of its rows among the ``total`` of ``left``. Keys
    of many rows, MOST_HOT at most, are sent to the rows; all others meet by a shuffle, which no key can
    then overload.
    """
    limit = max(HOT_ROWS, -(-total // MOST_HOT))
    more = [c for c in right.columns if c not in (*keys, "n")]
    extra = [f"_key_{i}" for i in range(len(keys))]
    held = right.select(*[F.col(k).alias(x) for k, x in zip(keys, extra, strict=True)], F.struct(*more, F.lit(1).alias("_there")).alias("_met"), "n")
    same = [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, extra, strict=True)]
    met = left.join(F.broadcast(held.where(F.col("n") > limit).drop("n")), same, "left").drop(*extra)
    rest = met.where("_met is null").drop("_met").join(held.where(F.col("n") <= limit).drop("n"), same).drop(*extra)
    both = met.where("_met is not null").unionByName(rest)
    return both.select(*left.columns, *[F.col("_met")[c].alias(c) for c in more])


def running_totals(df: DataFrame, by: list[str], order: list[str], values: list[str], prefix: str = "below_") -> DataFrame:
    """``df`` with the sums of ``values`` over the rows of its group that come before.

    Rows are dealt by range over group and order, so that a group is spread over as many tasks as it fills;
    the sums of each part are added to the parts behind it. ``order`` must tell the rows of a group apart.
    """
    dealt = written(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_part").agg(*[F.sum(v).alias(v) for v in values])
    parts = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of a group
    sums = sums.select(*by, "_part", *[F.coalesce(F.sum(v).over(parts), F.lit(0)).alias(f"_base_{v}") for v in values])
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"_own_{v}") for v in values])
    same = [F.col(f"_i.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in (*by, "_part")]
    met = inner.alias("_i").join(sums.alias("_s"), same)
    return met.select(*[f"_i.{c}" for c in df.columns], *[(F.col(f"_base_{v}") + F.col(f"_own_{v}")).alias(f"{prefix}{v}") for v in values])
