"""The phase of a run that measures: every report as a CSV of fixed columns, then the final table from them.

A report says its columns and how its rows come about; a run may be given others. The final table is built
from what was written and read back, as a later run would do it, not from what was in memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.sources.sinks import write_csv
from segno.sources.tables import read_csv

from . import divergence, summary
from .segment_metrics import METRICS, SEGMENT, aggregates, theme_means

PER_SEGMENT = "per_segment"
AGGREGATES = "model string, metric string, n_themes long, mean double, std double, median double, p25 double, p75 double, min double, max double"
SIGNIFICANCE = "metric string, model_a string, model_b string, n_a long, n_b long, u_statistic double, p_value double, `significant_at_0.05` boolean"
FINAL = "model string, metric string, grp string, " + ", ".join(f"{s} double" for s in summary.STATS)


@dataclass(frozen=True)
class Report:
    """A corpus measure: ``columns`` (DDL, in the order of its file), its rows, and the rows (model, key, numbers)
    that the final table reads from them."""

    name: str
    columns: str
    rows: Callable[[], DataFrame]
    order: tuple[str, ...]
    master: Callable[[DataFrame], DataFrame]


def names(columns: str) -> list[str]:
    return [c.strip().split(" ")[0].strip("`") for c in columns.split(", ")]


def wide_numbers(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """(model, key, mean ... max) from columns that are named with a prefix."""
    return df.select("model", F.lit(key).alias("key"), *[F.col(f"{prefix}_{s}").alias(s) for s in summary.STATS[:7]])


def wide_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(model, key, value) from columns whose names are the keys."""
    return df.unpivot(["model"], columns, "key", "value")


def report(folder: str, name: str, columns: str, df: DataFrame, order: tuple[str, ...], whole: bool = True, rounded: bool = True) -> DataFrame:
    """Write a table as ``folder/name.csv`` and read it back."""
    path = f"{folder}/{name}.csv"
    write_csv(df.select(*[F.col(f"`{c}`") for c in names(columns)]), path, list(order), whole=whole, rounded=rounded)
    return read_csv(df.sparkSession, path, columns)


def run(per_segment: DataFrame, reports: list[Report], folder: str, models: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """Write all reports below ``folder``; the readers' table (metric and a cell per model) as it was written.

    ``per_segment`` may be large and is written in parts; a report is a row per metric and model, or a few of
    them. What the final table asks for and no report has is an error that names it.
    """
    columns = "theme string, model string, sample_idx int, chunk_idx int, n_notes long, " + ", ".join(f"{m} double" for m in metrics)
    held = report(folder, PER_SEGMENT, columns, per_segment, tuple(SEGMENT), whole=False)
    numbers = report(folder, "aggregates", AGGREGATES, aggregates(held, metrics), ("model", "metric"), rounded=False)
    tests = divergence.mann_whitney(theme_means(held, metrics), ["metric"], models).withColumnRenamed("significant", "significant_at_0.05")
    report(folder, "significance", SIGNIFICANCE, tests, ("metric", "model_a", "model_b"), rounded=False)
    rows = [summary.master_rows(numbers.withColumnRenamed("metric", "key"), "aggregates", "key")]
    for r in reports:
        read = report(folder, r.name, r.columns, r.rows(), r.order)
        rows.append(summary.master_rows(r.master(read), r.name, "key"))
    final = report(folder, "final", FINAL, summary.final_table(reduce(DataFrame.unionByName, rows), models), (), rounded=False)
    cells = ", ".join(["metric string", *[f"`{m}` string" for m in models]])
    return report(folder, "final_human", cells, summary.human_table(final, models), ())
