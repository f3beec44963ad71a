"""Run state: work lists, derived status, upserts and repair against what is on disk.

``samples`` has theme, model, sample_idx, ok, error and ts; ``themes`` has theme, removed and chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import latest

SAMPLE = ["theme", "model", "sample_idx"]
MISSING = "files missing on disk"


def expected_samples(themes: DataFrame, models: list[str], per_theme: int) -> DataFrame:
    """Every sample that should exist."""
    named = themes.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return named.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(per_theme - 1)))) if per_theme else named.limit(0).withColumn("sample_idx", F.lit(0))


def work_list(expected: DataFrame, done: DataFrame, files: DataFrame) -> DataFrame:
    """What is neither done nor on disk, with its task id and seed."""
    open_ = expected.join(done.where("ok"), SAMPLE, "left_anti").join(files, SAMPLE, "left_anti")
    return open_.withColumn("task_id", F.concat_ws("/", "theme", "sample_idx")).withColumn("seed", F.lit(42) + F.col("sample_idx"))


def with_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with their outcome: the last result of a task counts, one without any died."""
    last = latest(results, ["task_id"], ["line_no"]).select("task_id", "ok", "error", F.lit(True).alias("_answered"))
    met = tasks.join(last, "task_id", "left")
    return met.withColumn("error", F.when(F.col("_answered").isNull(), "subprocess_died").otherwise(F.col("error"))).withColumn("ok", F.coalesce("ok", F.lit(False))).drop("_answered")


def marked(samples: DataFrame, changes: DataFrame) -> DataFrame:
    """Samples after an upsert: the latest row of each counts."""
    return latest(samples.unionByName(changes), SAMPLE, ["ts"])


def model_status(themes: DataFrame, samples: DataFrame, models: list[str], per_theme: int) -> DataFrame:
    """(theme, model, ord, ok): a model is ok when it has enough samples and all are ok."""
    order = themes.sparkSession.createDataFrame([(m, k) for k, m in enumerate(models)], "model string, ord int")
    wanted = themes.select("theme").join(F.broadcast(order))  # a few models beside each theme
    counts = samples.groupBy("theme", "model").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("all_ok"))
    met = wanted.join(counts, ["theme", "model"], "left")
    return met.select("theme", "model", "ord", ((F.coalesce("n", F.lit(0)) >= per_theme) & F.coalesce("all_ok", F.lit(True))).alias("ok"))


def derived_status(themes: DataFrame, samples: DataFrame, models: list[str], per_theme: int) -> DataFrame:
    """(theme, status, excluded_due_to): the first failing model in order, or removal, explains a failure."""
    status = model_status(themes, samples, models, per_theme)
    first = status.groupBy("theme").agg(F.bool_and("ok").alias("all_ok"), F.min_by(F.when(~F.col("ok"), F.col("model")), F.when(~F.col("ok"), F.col("ord"))).alias("failing"))
    met = themes.select("theme", "removed").join(first, "theme")
    return met.select(
        "theme",
        F.when(F.col("removed") | ~F.col("all_ok"), "fail").otherwise("ok").alias("status"),
        F.when(F.col("removed"), "removed_from_corpus").when(~F.col("all_ok"), F.col("failing")).alias("excluded_due_to"),
    )


def complete_samples(expected_chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(sample, complete): whether every chunk of a sample is there."""
    met = expected_chunks.join(files.select(*SAMPLE, "chunk_idx").distinct().withColumn("_there", F.lit(True)), [*SAMPLE, "chunk_idx"], "left")
    return met.groupBy(*SAMPLE).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("complete"))


def self_heal(themes: DataFrame, expected: DataFrame, samples: DataFrame, files: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples and themes after repair against disk and corpus.

    A sample whose files are there is ok; one that was ok without them fails; an unknown one without
    them stays unset. A theme without chunks fails all samples. A theme that is no longer in the corpus
    is removed, and one that is back is not.
    """
    met = expected.join(samples.select(*SAMPLE, "ok", "error"), SAMPLE, "left").join(files.select(*SAMPLE).distinct().withColumn("_there", F.lit(True)), SAMPLE, "left")
    short = F.coalesce(F.col("chunks"), F.lit(0)) == 0
    ok = F.when(short, False).when(F.col("_there"), True).when(F.col("ok"), False).otherwise(F.col("ok"))
    error = F.when(short, "theme too short").when(F.col("_there"), F.lit(None)).when(F.col("ok"), MISSING).otherwise(F.col("error"))
    healed = met.select(*SAMPLE, ok.alias("ok"), error.alias("error"))
    corpus = on_disk.select("theme").distinct().withColumn("_there", F.lit(True))
    kept = themes.join(corpus, "theme", "left").withColumn("removed", F.col("_there").isNull()).drop("_there")
    return healed, kept


def failures(samples: DataFrame, themes: DataFrame) -> DataFrame:
    """One line of text for each failed sample of a theme that is not removed; an error without a text, or with an empty one, is unknown."""
    kept = samples.where("not ok").join(themes.where("not removed").select("theme"), "theme", "left_semi")
    error = F.when(F.length("error") > 0, F.col("error")).otherwise("unknown")
    return kept.select(F.format_string("%-30s sample_%d %-8s — %s", "theme", "sample_idx", "model", error).alias("value"))


def drop_split(splits: DataFrame) -> DataFrame:
    """A check that no name is in two buckets: rows are the offenders."""
    return splits.groupBy("name").agg(F.count_distinct("bucket").alias("n")).where("n > 1")
