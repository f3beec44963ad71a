"""The master table of all metrics and models, its checks, and the pivoted table for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.functions import music

from .relational import required_join

STATS = ["mean", "std", "median", "p25", "p75", "min", "max", "kl", "oa", "value"]

#: Metrics of the final table in order: name, group, source, key in the source (fixed values).
FINAL_METRICS = (
    ("mgeval_pc", "B", "mgeval", "total_used_pitch"),
    ("mgeval_pr", "B", "mgeval", "pitch_range"),
    ("mgeval_pi", "B", "mgeval", "avg_pitch_interval"),
    ("mgeval_nc", "B", "mgeval", "total_used_note"),
    ("mgeval_ioi", "B", "mgeval", "avg_ioi"),
    ("mgeval_pch", "B", "mgeval", "total_pitch_class_histogram"),
    ("mgeval_pctm", "B", "mgeval", "pitch_class_transition_matrix"),
    ("mgeval_nlh", "B", "mgeval", "note_length_hist"),
    ("mgeval_nltm", "B", "mgeval", "note_length_transition_matrix"),
    ("scale_match", "A", "aggregates", "scale_match"),
    ("scale_match_per_time", "A", "aggregates", "scale_match_per_time"),
    ("chord_tone_ratio", "A", "aggregates", "ctr"),
    ("ctr_first_beat", "A", "aggregates", "ctr_first_beat"),
    ("chord_match_per_time", "A", "aggregates", "chord_match_per_time"),
    ("bar_rhythm_jsd", "C", "bar_rhythm_jsd", "jsd"),
    ("note_density", "A", "aggregates", "note_density"),
    ("pitch_entropy", "A", "aggregates", "pitch_entropy"),
    ("theme_ngram_overlap_n3", "A", "aggregates", "ngram_3_overlap"),
    ("theme_ngram_overlap_n4", "A", "aggregates", "ngram_4_overlap"),
    ("theme_ngram_overlap_n5", "A", "aggregates", "ngram_5_overlap"),
    ("plagiarism_ngram_n3", "C", "plagiarism", "ngram_overlap_n3"),
    ("plagiarism_ngram_n4", "C", "plagiarism", "ngram_overlap_n4"),
    ("plagiarism_ngram_n5", "C", "plagiarism", "ngram_overlap_n5"),
    ("plagiarism_lcs", "D", "plagiarism", "lcs_max"),
)


def registry(spark: SparkSession, metrics=FINAL_METRICS) -> DataFrame:
    return spark.createDataFrame([(k, *m) for k, m in enumerate(metrics)], "ord int, metric string, grp string, source string, source_key string")


def master_rows(found: DataFrame, source: str, key: str, metrics=FINAL_METRICS) -> DataFrame:
    """(model, metric, ten numbers) of one source: rows whose key no metric asks for are dropped."""
    known = registry(found.sparkSession, metrics).where(F.col("source") == source).select("metric", F.col("source_key").alias(key))
    met = found.join(F.broadcast(known), key)
    return met.select("model", "metric", *[(F.col(s).try_cast("double") if s in found.columns else F.lit(None).cast("double")).alias(s) for s in STATS])


def final_table(master: DataFrame, models: list[str], metrics=FINAL_METRICS) -> DataFrame:
    """Every metric of every model in order; a missing row is an error that names it."""
    spark = master.sparkSession
    order = spark.createDataFrame([(m, k) for k, m in enumerate(models)], "model string, model_ord int")
    wanted = registry(spark, metrics).join(order)
    out = required_join(wanted, master, ["metric", "model"], "no row for ")
    return out.orderBy("ord", "model_ord").select("model", "metric", "grp", *STATS)


def cell(group: Column) -> Column:
    """A reader's cell: three places, a dash for null, a form for each group."""
    f = lambda c: F.when(F.col(c).isNull(), "—").otherwise(music.places(F.col(c), 3))
    spread = F.concat(F.lit("mean = "), f("mean"), F.lit(" ± "), f("std"), F.lit("\nmedian = "), f("median"), F.lit(" ("), f("p25"), F.lit("–"), f("p75"), F.lit(")"))
    divergence = F.concat(F.lit("KL = "), f("kl"), F.lit("\nOA = "), f("oa"))
    unknown = F.raise_error(F.concat(F.lit("unknown group "), group)).cast("string")
    return F.when(group.isin("A", "D"), spread).when(group == "B", divergence).when(group == "C", f("value")).otherwise(unknown)


def human_table(final: DataFrame, models: list[str], metrics=FINAL_METRICS) -> DataFrame:
    """A row per metric with a cell for each model, empty where there is none."""
    cells = final.select("metric", "model", cell(F.col("grp")).alias("cell"))
    wide = cells.groupBy("metric").pivot("model", models).agg(F.first("cell"))
    out = registry(final.sparkSession, metrics).select("ord", "metric").join(wide, "metric", "left").na.fill("", models)
    return out.orderBy("ord").select("metric", *models)
