"""How much generated pieces copy a training corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segno.functions import music
from segno.shared import written

from .relational import eight_numbers
from .suffixes import longest_common_runs


SIZES = (3, 4, 5)


def pooled_overlaps(train: DataFrame, generated: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(model, size, n_grams, n_copied, overlap): the share of all generated n-grams, repeats included, that occur in training.

    Both have ``seq`` (array of int). All sizes are counted in one pass, equal n-grams before the join, which
    then has one row per distinct n-gram and model. A model without an n-gram of a size has no row of it.
    """
    sized = lambda n: F.transform(music.ngrams(F.col("seq"), n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("gram")))
    every = F.flatten(F.array(*[sized(n) for n in sizes]))
    known = train.select(F.explode(every).alias("x")).select("x.*").distinct().withColumn("known", F.lit(True))
    pool = generated.select("model", F.explode(every).alias("x")).groupBy("model", "x.size", "x.gram").agg(F.count(F.lit(1)).alias("k"))
    met = pool.join(known, ["size", "gram"], "left").groupBy("model", "size")
    met = met.agg(F.sum("k").alias("n_grams"), F.sum(F.when(F.col("known"), F.col("k")).otherwise(0)).alias("n_copied"))
    return met.select("model", "size", "n_grams", "n_copied", (F.col("n_copied") / F.col("n_grams")).alias("overlap"))


def pooled_overlap(train: DataFrame, generated: DataFrame, n: int) -> DataFrame:
    return pooled_overlaps(train, generated, (n,)).drop("size")


def lcs_summary(generated: DataFrame, train: DataFrame) -> DataFrame:
    """Seven numbers of the longest runs by model (population spread); empty pieces count but have no run."""
    runs = longest_common_runs(generated.where(F.size("seq") > 0), train)
    numbers = eight_numbers(runs.withColumn("x", F.col("lcs").cast("double")), ["model"], "x", sample=False).withColumnRenamed("n", "n_gen_chunks_lcs")
    counts = generated.groupBy("model").agg(F.count(F.lit(1)).alias("n_gen_chunks"))
    return counts.join(numbers, "model", "left")


def _or_error(value: str, text: str) -> Column:
    """A number that must be there: none, or null, is an error that names the model."""
    fault = F.raise_error(F.concat(F.lit(text), F.col("model"))).cast("long")
    return F.when(F.coalesce(F.col(value), F.lit(0)) == 0, fault).otherwise(F.col(value)).alias(value)


def plagiarism(generated: DataFrame, train: DataFrame, models: list[str], sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """A row per model: overlaps of the pooled n-grams, seven numbers of the longest runs, and all counts.

    ``generated`` has (model, chunk, seq) and ``train`` a column seq; both are written once. An empty training
    corpus, a model without pieces, without one that has symbols, or without an n-gram of a size is an error.
    """
    spark = generated.sparkSession
    generated = written(generated.where(F.col("model").isin(models)).select("model", "chunk", "seq"))
    train = written(train.select("seq"))
    if train.isEmpty():
        raise ValueError("the training corpus is empty")
    asked = spark.createDataFrame([(m,) for m in models], "model string")
    runs = asked.join(lcs_summary(generated, train), "model", "left")
    pools = pooled_overlaps(train, generated, sizes).groupBy("model").pivot("size", list(sizes)).agg(F.first("overlap").alias("overlap"), F.first("n_grams").alias("n"))
    out = runs.join(pools, "model", "left").withColumn("n_train_pieces", F.lit(train.count()).cast("long"))
    shares = [F.col(f"{n}_overlap").alias(f"ngram_overlap_n{n}") for n in sizes]
    numbers = [F.col(c).alias(f"lcs_max_{c}") for c in ("mean", "std", "median", "p25", "p75", "min", "max")]
    counts = [_or_error("n_gen_chunks", "no generated pieces of "), _or_error("n_gen_chunks_lcs", "no generated piece with symbols of ")]
    grams = [_or_error(f"{n}_n", f"no {n}-grams of ").alias(f"n_gen_ngrams_n{n}") for n in sizes]
    return out.select("model", *shares, *numbers, *counts, *grams, "n_train_pieces")
