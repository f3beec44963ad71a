"""Checks as tables of violations, and guards that refuse to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METER = (4, 4)


def chorus_count(input_bars: Column, output_bars: Column) -> Column:
    """Choruses to play so that ``output_bars`` follow the theme, which is the first."""
    return F.floor(output_bars / input_bars).cast("int") + 1


def task_violations(tasks: DataFrame) -> DataFrame:
    """(task_id, violation): every rule that a task breaks.

    A task has task_id, rule, input_bars, output_bars, num_bars, measures, ts_num and ts_den. The rule
    ``mirror`` asks for as many bars as were given and for half of the model's; ``multiple`` for whole
    choruses; any other for nothing more. A score without a meter counts as 4/4.
    """
    given, asked = F.col("input_bars"), F.col("output_bars")
    meter = (F.coalesce("ts_num", F.lit(METER[0])) != METER[0]) | (F.coalesce("ts_den", F.lit(METER[1])) != METER[1])
    mirror, multiple = F.col("rule") == "mirror", F.col("rule") == "multiple"
    rules = {
        "input_bars must be positive": given <= 0,
        "output_bars must be positive": asked <= 0,
        "fewer measures than input_bars": F.col("measures") < given,
        "meter must be 4/4": meter,
        "output_bars must equal input_bars": mirror & (given != asked),
        "output_bars must be half of num_bars": mirror & (asked * 2 != F.col("num_bars")),
        "output_bars must be a multiple of input_bars": multiple & (given > 0) & (F.pmod(asked, F.when(given > 0, given)) != 0),
    }
    broken = F.array(*[F.when(rule, F.lit(text)) for text, rule in rules.items()])
    return tasks.select("task_id", F.explode(F.array_compact(broken)).alias("violation"))


def key_differences(found: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): keys that are required and missing, and those that are there and unknown."""
    a = required.select(*keys).distinct().withColumn("_required", F.lit(True))
    b = found.select(*keys).distinct().withColumn("_found", F.lit(True))
    met = a.join(b, keys, "full").where("_required is null or _found is null")
    return met.select(*keys, F.when(F.col("_found").isNull(), "missing").otherwise("unknown").alias("problem"))


def collisions(outputs: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, problem): output paths that two tasks share or that exist already."""
    twice = outputs.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.lit("written twice").alias("problem"))
    there = outputs.select("path").distinct().join(existing.select("path"), "path", "left_semi").withColumn("problem", F.lit("exists"))
    return twice.unionByName(there)


def guard_resume(held: str | None, now: str) -> None:
    """A run goes on only with the configuration that it began with; one without a digest is new."""
    if held and held != now:
        raise ValueError(f"the run began with configuration {held}, not {now}: start it anew or give it another name")
