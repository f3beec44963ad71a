"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.shared import written

from .quantiles import SMALL, quantiles


def _fields(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(c) for c in df.columns]).alias(name)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, tie: str, match: str = "match") -> DataFrame:
    """Each left row with the last right row of its group at or before its place, as a struct.

    One shuffle on ``by`` and one sort: both sides are laid on one line and the last right row is
    carried forward. Of right rows at one place the one with the largest ``tie`` counts.
    """
    r = right.select(*by, F.col(right_at).cast("double").alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), _fields(right, "_right"))
    r = r.withColumn("_left", F.lit(None).cast(left.select(_fields(left, "x")).schema["x"].dataType))
    q = left.select(*by, F.col(left_at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), _fields(left, "_left"))
    q = q.withColumn("_right", F.lit(None).cast(r.schema["_right"].dataType))
    line = Window.partitionBy(*by).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(q).withColumn("_last", F.last("_right", ignorenulls=True).over(line))
    return both.where("_side = 1").select(*[F.col("_left")[c].alias(c) for c in left.columns], F.col("_last").alias(match))


def band_self_join(rows: DataFrame, by: list[str], ends: str, starts: str, width: float, order: str) -> DataFrame:
    """Pairs (a, b) of a group with |a.ends - b.starts| < width, by buckets of that width.

    Each row looks only into three neighbouring buckets, so a group is never paired out.
    """
    a = rows.select(*by, F.struct(*rows.columns).alias("a"), F.explode(F.array(*[F.floor(F.col(ends) / width) + k for k in (-1, 0, 1)])).alias("_bucket"))
    b = rows.select(*by, F.struct(*rows.columns).alias("b"), F.floor(F.col(starts) / width).alias("_bucket"))
    met = a.join(b, [*by, "_bucket"]).where(F.abs(F.col(f"a.{ends}") - F.col(f"b.{starts}")) < width)
    return met.where(F.col(f"a.{order}") != F.col(f"b.{order}")).select(*by, "a", "b")


def near_downbeat(at: Column, bar: Column, last: Column, tolerance: Column) -> Column:
    """Whether a place is within a tolerance of a downbeat that is not after ``last``."""
    nearest = F.least(F.rint(at / bar), F.floor(last / bar))
    return F.abs(at - nearest * bar) <= tolerance


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(line))


def chunk_rows(df: DataFrame, by: list[str], order: list[str], size: int, out: str = "chunk") -> DataFrame:
    """Rows in runs of ``size``; a shorter tail is dropped."""
    line = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(line) - 1).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return numbered.withColumn(out, F.floor(F.col("_n") / size).cast("int")).where(F.col(out) < F.floor(F.col("_of") / size)).drop("_n", "_of")


def chains(df: DataFrame, by: list[str], order: list[str], opens: Column, out: str = "chain") -> DataFrame:
    """Numbers of runs, each begun by a row that opens one."""
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(opens, 1).otherwise(0)).over(line))


def changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row of a group counts as one."""
    line = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_before", F.lag(value).over(line)).withColumn("_n", F.row_number().over(line))
    return marked.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def differences(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """A value less that of the row before; first rows are dropped."""
    line = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(line)).where(F.col(out).isNotNull())


def top_n(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def crosstab(df: DataFrame, rows: str, columns: str, row_order: list[str], column_order: list[str]) -> DataFrame:
    """Counts with fixed rows and columns, zero where nothing met."""
    wide = df.groupBy(rows).pivot(columns, column_order).count()
    fixed = df.sparkSession.createDataFrame([(x,) for x in row_order], f"{rows} string")
    return F.broadcast(fixed).join(wide, rows, "left").na.fill(0, column_order)


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def eight_numbers(df: DataFrame, by: list[str], value: str, sample: bool = True, small: int = SMALL) -> DataFrame:
    """n, mean, std, median, p25, p75, min and max of the values that are there; NaN counts as missing.

    ``std`` is that of a sample (null for one value) or, as asked, of the population. A group without
    values has n = 0. Quantiles of groups beyond ``small`` values are selected by rank, not in one task.
    """
    spread = F.stddev_samp if sample else F.stddev_pop
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    held = written(df.select(*by, number.alias("x")))
    out = held.groupBy(*by).agg(F.avg("x").alias("mean"), spread("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    ranks = quantiles(held.where("x is not null"), by, [0.25, 0.5, 0.75], small)
    same = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in by] or [F.lit(True)]
    met = out.alias("_a").join(ranks.alias("_b"), same, "left")
    n, q = F.coalesce("_b.n", F.lit(0)).cast("long").alias("n"), F.col("_b.q")
    return met.select(*[F.col(f"_a.{c}").alias(c) for c in by], n, "_a.mean", "_a.std", q[1].alias("median"), q[0].alias("p25"), q[2].alias("p75"), "_a.min", "_a.max")


def required_join(wanted: DataFrame, found: DataFrame, keys: list[str], message: str) -> DataFrame:
    """An inner join that fails, with the key, where a wanted row is missing."""
    marked = found.withColumn("_there", F.lit(True))
    joined = wanted.join(marked, keys, "left")
    missing = F.concat(F.lit(message), F.to_json(F.struct(*keys)))
    checked = joined.withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(missing).cast("boolean")).otherwise(F.col("_there")))
    return checked.where("_there").drop("_there")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (upsert: later rows replace earlier ones)."""
    line = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal bins from the least to the largest value, which belongs to the last bin."""
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    spread = df.join(F.broadcast(ends))  # one row
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1)))
    return spread.select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
