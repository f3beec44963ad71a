"""Exact quantiles of groups of any size, by selecting ranks in several passes.

A group that fits in a task is sorted there. In a larger one each wanted rank is looked for in the range
of values that must hold it: a pass counts the range's values in equal bins, on the map side first, and
the bin that holds the rank is the next range, cut to the values that it has. When few values are left
they are put in order. So no task ever holds a large group, and a pass moves counts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.shared import written

#: Values that one task puts in order, bins of a pass, and groups that can be larger than that at most.
SMALL, BINS, MOST_LARGE = 65_536, 1024, 50_000


def _same(by: list[str], other: str) -> list[Column]:
    return [F.col(f"_v.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in by] or [F.lit(True)]


def _inside(held: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """The values of each range, with the range's columns; the ranges are a few of MOST_LARGE groups."""
    met = held.alias("_v").join(F.broadcast(ranges.alias("_r")), [*_same(by, "_r"), F.col("_v.x").between(F.col("_r.low"), F.col("_r.high"))])
    return met.select("_r.*", "_v.x")


def _narrowed(held: DataFrame, ranges: DataFrame, by: list[str], bins: int) -> DataFrame:
    key = [*by, "rank"]
    width = (F.col("high") / bins) - (F.col("low") / bins)
    at = F.when(width > 0, F.least(F.floor((F.col("x") / bins - F.col("low") / bins) / width * bins), F.lit(bins - 1))).otherwise(F.when(F.col("x") > F.col("low"), 1).otherwise(0))
    counts = _inside(held, ranges, by).groupBy(*key, "skip", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    line = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
    counts = counts.withColumn("skip", F.col("skip") + F.coalesce(F.sum("n").over(line), F.lit(0)))
    return counts.where("skip <= rank and rank < skip + n").select(*key, "low", "high", "skip", "n")


def select_ranks(held: DataFrame, large: DataFrame, by: list[str], shares: list[float], limit: int, bins: int = BINS) -> DataFrame:
    """(by, rank, x): the values at the ranks that quantiles of the large groups lie between.

    ``held`` has (by, x) and ``large`` (by, n, low, high).
    """
    key = [*by, "rank"]
    ranks = [f(F.lit(p) * (F.col("n") - 1)).cast("long") for p in shares for f in (F.floor, F.ceil)]
    now = large.select(*by, "low", "high", "n", F.explode(F.array_distinct(F.array(*ranks))).alias("rank"))
    now = written(now.select(*key, "low", "high", F.lit(0).cast("long").alias("skip"), "n"))
    done = []
    while True:
        done.append(now.where(f"low = high or n <= {limit}"))
        wide = now.where(f"low < high and n > {limit}")
        if wide.isEmpty():
            break
        now = written(_narrowed(held, wide, by, bins))
    ended = reduce(DataFrame.unionByName, done)
    single = ended.where("low = high").select(*key, F.col("low").alias("x"))
    line = Window.partitionBy(*key).orderBy("x")  # at most ``limit`` rows
    few = _inside(held, ended.where("low < high"), by).withColumn("_k", F.row_number().over(line) - 1)
    return single.unionByName(few.where("_k = rank - skip").select(*key, "x"))


def quantiles(held: DataFrame, by: list[str], shares: list[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(by, n, q): the number of values of each group and their quantiles, linear between ranks.

    ``held`` has (by, x) without nulls or NaN and is read several times: hand over a table that is written.
    """
    sizes = written(held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    limit = max(small, -(-total // MOST_LARGE))
    large = sizes.where(F.col("n") > limit)
    at_once = F.percentile("x", F.array(*[F.lit(p) for p in shares])).alias("q")
    if large.isEmpty():
        return held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), at_once)
    rest = held.alias("_v").join(F.broadcast(large.alias("_l")), _same(by, "_l"), "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), at_once)
    found = select_ranks(held, large, by, shares, limit, bins).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))  # two for each share
    met = large.alias("_v").join(found.alias("_m"), _same(by, "_m")).select("_v.*", "_m.m")

    def between(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("m", low), F.element_at("m", high)
        return F.when(low == high, a).otherwise(a * (high - place) + b * (place - low))

    return rest.unionByName(met.select(*by, "n", F.array(*[between(p) for p in shares]).alias("q")))
