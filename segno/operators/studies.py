"""Studies over trials: seeded selections, the noise of a corpus against itself, and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import divergence, sampling
from .distances import distance_samples, half_samples

#: Trials whose pairs are measured together; vectors lie in up to 2 ** so many groups.
MOST_AT_ONCE = 6


def selections(df: DataFrame, key: str, k: int, seeds: list[int]) -> DataFrame:
    """(trial, key): the names that each trial selects, in order within a trial."""
    return sampling.trials(df.select(key).distinct(), key, k, seeds).select("trial", key)


def selected_once(selected: DataFrame, key: str) -> DataFrame:
    """(key, n_trials): every name that some trial selects, for work that is done once for all."""
    return selected.groupBy(key).agg(F.count_distinct("trial").alias("n_trials"))


def half_noise(vectors: DataFrame, by: list[str], seeds: list[int]) -> DataFrame:
    """(by, trial, kl, oa): each trial's first half as the real corpus, the second against it.

    ``vectors`` has ``by``, id and vec. What a corpus shows against itself is the floor of the measure.
    """
    halves = sampling.halves(vectors.select("id").distinct(), "id", seeds)
    out = None
    for k in range(0, len(seeds), MOST_AT_ONCE):
        some = seeds[k : k + MOST_AT_ONCE]
        bit = reduce(lambda x, t: F.when(F.col("trial") == some[t], F.lit(1 << t)).otherwise(x), range(len(some)), F.lit(0))
        first = halves.where(F.col("trial").isin(some)).groupBy("id").agg(F.sum(F.when(F.col("half") == "a", bit).otherwise(0)).alias("first"))
        samples = half_samples(vectors.join(first, "id"), by, some)
        out = samples if out is None else out.unionByName(samples)
    key = [*by, "trial"]
    found = divergence.kl_and_overlap(out, key).drop("model")
    return found.withColumn("trial", F.col("trial").cast(halves.schema["trial"].dataType))


def bias(real: DataFrame, generated: DataFrame, by: list[str], k: int, seeds: list[int]) -> DataFrame:
    """(by, trial, model, kl, oa): generated pieces of the names that a trial selects against the real ones of the same names.

    ``real`` has ``by``, id and vec, ``generated`` a model too; an id is a name in both.
    """
    chosen = selections(real, "id", k, seeds)
    key = [*by, "trial"]
    return divergence.kl_and_overlap(distance_samples(real.join(chosen, "id"), generated.join(chosen, "id"), key), key)


def summary(measured: DataFrame, by: list[str]) -> DataFrame:
    """Mean, spread and ends of KL and overlap over trials."""
    return sampling.trial_summary(measured, by, ["kl", "oa"])


def factorial(cells: DataFrame, by: list[str], factors: tuple[str, str], levels: dict[str, tuple[str, str]], values: list[str]) -> DataFrame:
    """(by, term, values) of a 2 x 2 study: its four cells, the mean of each level, both main effects and the interaction.

    ``cells`` has (by, both factors, values). One pass over grouping sets gives cells, levels and the whole. A main
    effect is the mean at a factor's second level less that at its first; the interaction is what the first
    factor's effect gains from the second factor's first level to its second. A study that lacks a cell has
    null effects.
    """
    a, b = factors
    for f in factors:
        cells = cells.where(F.col(f).isin(*levels[f]))
    sets = [[*by, a, b], [*by, a], [*by, b], list(by)]
    every = cells.groupingSets([[F.col(c) for c in s] for s in sets], *by, a, b).agg(*[F.avg(v).alias(v) for v in values])
    name = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("_", a, b)).otherwise(F.coalesce(a, b, F.lit("all")))
    named = every.select(*by, name.alias("term"), *values)
    (a0, a1), (b0, b1) = levels[a], levels[b]
    at = lambda v, term: F.max(F.when(F.col("term") == term, F.col(v)))
    complete = F.count(F.when(F.col("term").isin(*[f"{x}_{y}" for x in levels[a] for y in levels[b]]), 1)) == 4
    effects = {
        a: lambda v: at(v, a1) - at(v, a0),
        b: lambda v: at(v, b1) - at(v, b0),
        "interaction": lambda v: (at(v, f"{a1}_{b1}") - at(v, f"{a0}_{b1}")) - (at(v, f"{a1}_{b0}") - at(v, f"{a0}_{b0}")),
    }
    rows = F.array(*[F.struct(F.lit(f"effect_{k}").alias("term"), *[F.when(complete, make(v)).alias(v) for v in values]) for k, make in effects.items()])
    found = named.groupBy(*by).agg(rows.alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")
    return named.unionByName(found)


def wide_cells(cells: DataFrame, by: list[str], factors: tuple[str, str], levels: dict[str, tuple[str, str]], values: list[str]) -> DataFrame:
    """(by, <first level>_<second level>_<value> ...): a study's table with a row per ``by``, as its report has it."""
    a, b = factors
    at = [F.max(F.when((F.col(a) == x) & (F.col(b) == y), F.col(v))).alias(f"{x}_{y}_{v}") for x in levels[a] for y in levels[b] for v in values]
    return cells.groupBy(*by).agg(*at)


def read_cells(wide: DataFrame, by: list[str], factors: tuple[str, str], levels: dict[str, tuple[str, str]], values: list[str]) -> DataFrame:
    """The rows (by, factors, values) that a wide table of a study was made from; a cell without any value has none."""
    a, b = factors
    held = F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b), *[F.col(f"{x}_{y}_{v}").alias(v) for v in values]) for x in levels[a] for y in levels[b]])
    return wide.select(*by, F.explode(held).alias("x")).select(*by, "x.*").where(F.coalesce(*values).isNotNull())
