"""Seeded samples, splits and trials that any engine can repeat.

Order comes from md5 of seed and key, so a draw depends neither on partitions nor on the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: Column | int, key: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("-", seed.cast("string"), key.cast("string")))


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows without replacement (all if there are fewer): a sampling operator's own limit."""
    return df.withColumn("_draw", draw_key(seed, F.col(key))).orderBy("_draw", key).limit(k).drop("_draw")


#: Rows of a trial up to which Spark limits every task's share before the rows are dealt (its own bound).
GROUP_LIMIT = 1000


def trials(df: DataFrame, key: str, k: int, seeds: list[int]) -> DataFrame:
    """Rows of every trial (a column), each a sample of ``k`` without replacement.

    Small samples are the first rows of a window, of which each task hands on ``k`` at most; in larger ones the
    rows are ranked by buckets of their draw. So no task gets a trial's whole table.
    """
    spread = df.withColumn("trial", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("_draw", draw_key(F.col("trial"), F.col(key)))
    if k < GROUP_LIMIT:
        line = Window.partitionBy("trial").orderBy("_draw", key)
        return spread.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= k).drop("_n", "_draw")
    return _with_rank(spread, ["_draw", key], ["trial"]).where(F.col("_rank") <= k).drop("_rank", "_draw")


def halves(df: DataFrame, key: str, seeds: list[int]) -> DataFrame:
    """Every trial's random halves: ``half`` is 'a' for the first half of the draw, else 'b'."""
    spread = df.withColumn("trial", F.explode(F.array(*[F.lit(s) for s in seeds])))
    sizes = spread.groupBy("trial").agg(F.count(F.lit(1)).alias("_of"))  # a row per trial
    ranked = _with_rank(spread.withColumn("_draw", draw_key(F.col("trial"), F.col(key))), ["_draw", key], ["trial"])
    met = ranked.join(F.broadcast(sizes), "trial")
    return met.withColumn("half", F.when(F.col("_rank") <= F.floor(F.col("_of") / 2), "a").otherwise("b")).drop("_draw", "_rank", "_of")


def split(df: DataFrame, key: str, seed: int = 0, share: float = 0.1, excluded: list[str] | None = None) -> DataFrame:
    """(key, bucket): floor(share n) keys for eval, as many for test, the rest for train.

    Excluded keys leave test, not train. Ranks come from counts of 256 buckets of the draw, not from a
    single task.
    """
    keys = df.select(key).distinct().withColumn("_draw", draw_key(seed, F.col(key)))
    n = keys.count()
    size = int(n * share)
    ranked = _with_rank(keys, ["_draw", key])
    bucket = F.when(F.col("_rank") <= size, "eval").when(F.col("_rank") <= 2 * size, "test").otherwise("train")
    out = ranked.select(key, bucket.alias("bucket"))
    if excluded:
        gone = df.sparkSession.createDataFrame([(x,) for x in excluded], f"{key} string")
        out = out.join(F.broadcast(gone.withColumn("_gone", F.lit(True))), key, "left").where((F.col("bucket") != "test") | F.col("_gone").isNull()).drop("_gone")
    return out


def _with_rank(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, of the whole or of each ``by``: hashed draws fall into 256 even buckets by their first two digits."""
    by = by or []
    bucketed = df.withColumn("_bucket", F.substring(order[0], 1, 2))
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_in"))  # 256 rows at most for each
    line = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "_bucket", F.coalesce(F.sum("_in").over(line), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return bucketed.join(F.broadcast(before), [*by, "_bucket"]).withColumn("_rank", F.col("_before") + inside).drop("_bucket", "_before")


def trial_summary(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean, population spread, least and largest over trials, for each value column."""
    out = [F.count(F.lit(1)).alias("n_trials")]
    for v in values:
        out += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return df.groupBy(*by).agg(*out)
