"""Longest runs that pieces of one corpus share with another, by doubling ranks and suffix order.

All places of both corpora are named by the few symbols that stand there. In each round the names of a
place and of the place as far behind it as the names reach give the name of twice the length; a name
that only one corpus has is dropped with its places, since nothing longer from there is shared. So after
log2 of the longest shared run nothing is left, and each generated piece is finished in the last round
that it has a place in. There its longest run begins with one of the names and is less than twice as long.
The places that share a name are ordered by what follows; the nearest training suffix before and behind
a generated one has the longest common beginning with it.

A name is the least of its places, so it is the same whenever it is computed. Each round is written down
before the next, so the plan does not grow, and names that many places bear are joined apart from the
others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.functions import music
from segno.shared import join_counted, written

#: Symbols of the first names. Shorter runs are found from single symbols and the few that follow.
FIRST = 4


def _both(places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, id): the names that both corpora have, with their number of places and the least of them."""
    counts = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p", "at")).alias("id"), F.min("own").alias("_least"), F.max("own").alias("_most"))
    return counts.where("_least <> _most").drop("_least", "_most")


def common_length(a: Column, b: Column) -> Column:
    """How many symbols two arrays begin with in common; null has none."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shorter = F.least(F.size(a), F.size(b))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.when(differs > 0, F.least(differs.cast("int") - 1, shorter)).otherwise(shorter))


def _finish(ends: DataFrame, train: DataFrame, pieces: DataFrame, length: int, more: int, total: int) -> DataFrame:
    """(p, run) of generated places whose runs are ``length`` symbols, which their names stand for, and up to ``more`` others."""
    following = F.slice("seq", F.col("at") + 1 + length, more).alias("tail")
    seqs = pieces.select("p", "seq")
    own = ends.join(seqs, "p").select("p", "id", following)
    asked = own.groupBy("id", "tail").agg(F.count(F.lit(1)).alias("n"))
    other = train.join(seqs, "p").select("id", following).distinct()
    other = other.join(asked.select("id").distinct(), "id", "left_semi")
    none = F.lit(None).cast(other.schema["tail"].dataType)
    line = other.select("id", "tail", F.col("tail").alias("known"), F.lit(None).cast("long").alias("n")).unionByName(asked.select("id", "tail", none.alias("known"), "n"))
    # Distinct tails of one name; what lies behind is read from the other end, as a frame with an open end is not linear.
    up, down = (Window.partitionBy("id").orderBy(c).rangeBetween(Window.unboundedPreceding, 0) for c in (F.asc("tail"), F.desc("tail")))
    before, behind = F.last("known", ignorenulls=True).over(up), F.last("known", ignorenulls=True).over(down)
    met = line.withColumn("_a", before).withColumn("_b", behind).where("n is not null and (_a is not null or _b is not null)")
    run = F.greatest(common_length(F.col("tail"), F.col("_a")), common_length(F.col("tail"), F.col("_b"))) + length
    found = met.select("id", "tail", "n", run.cast("long").alias("run"))
    return join_counted(own, found, ["id", "tail"], total).groupBy("p").agg(F.max("run").alias("run"))


def longest_common_runs(generated: DataFrame, train: DataFrame) -> DataFrame:
    """(model, chunk, lcs): for each generated piece the longest run of symbols it shares with any training piece.

    ``generated`` has (model, chunk, seq) and ``train`` a column seq. A null symbol equals a null symbol; a
    piece that shares nothing, or has no symbol, has 0. Repeated rows each count.
    """
    symbols = F.col("seq").cast("array<long>").alias("seq")
    own = generated.select(F.lit(True).alias("own"), "model", "chunk", symbols)
    other = train.select(F.lit(False).alias("own"), *[F.lit(None).cast(generated.schema[c].dataType).alias(c) for c in ("model", "chunk")], symbols)
    pieces = written(own.unionByName(other).withColumn("p", F.monotonically_increasing_id()))
    singles = pieces.select("own", "p", F.posexplode("seq").alias("at", "cls"))
    total = singles.count()
    grams = pieces.select("own", "p", F.posexplode(music.ngrams(F.col("seq"), FIRST)).alias("at", "cls"))
    alive = written(join_counted(grams, _both(grams, ["cls"]), ["cls"], total).drop("cls"))
    # Pieces that share no such name have runs of fewer symbols, or none.
    short = singles.where("own").join(alive.where("own").select("p").distinct(), "p", "left_anti")
    symbol = lambda places: places.select("p", "at", F.struct("cls").alias("id"))
    found = [written(_finish(symbol(short), symbol(singles.where("not own")), pieces, 1, FIRST - 2, total))]
    length = FIRST
    while not alive.isEmpty():
        ahead = F.first("id").over(Window.partitionBy("p").orderBy("at").rangeBetween(length, length))
        pairs = alive.select("own", "p", "at", "id", ahead.alias("ahead")).where("ahead is not null")
        named = _both(pairs.withColumnRenamed("id", "cls"), ["cls", "ahead"])
        longer = written(join_counted(pairs.withColumnRenamed("id", "cls"), named, ["cls", "ahead"], total).select("own", "p", "at", "id"))
        ends = alive.where("own").join(longer.where("own").select("p").distinct(), "p", "left_anti")
        found.append(written(_finish(ends, alive.where("not own"), pieces, length, length - 1, total)))
        alive, length = longer, 2 * length
    runs = reduce(DataFrame.unionByName, found)
    every = pieces.where("own").select("p", "model", "chunk")
    return every.join(runs, "p", "left").select("model", "chunk", F.coalesce("run", F.lit(0)).cast("long").alias("lcs"))
