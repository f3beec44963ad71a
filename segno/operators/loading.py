"""Corpora from files that may be missing, broken or empty: what is skipped, what is kept, and why.

Parsed notes have a name, seq_no, pitch and an error, which is null unless the file could not be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from segno.functions import music
from segno.sources.scores import file_parts

from .domain import bar_chunks
from .sampling import draw_key

STATUSES = ("ok", "missing", "parse_error", "too_short")
#: Notes that a piece needs to have an interval.
LEAST_NOTES = 2


def listing(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """Paths in order; only the first of them if a limit is asked for."""
    ordered = paths.select("path").distinct().orderBy("path")
    return ordered if limit is None else ordered.limit(limit)


def names(paths: DataFrame) -> DataFrame:
    """The distinct names of the folders that hold the files, in order."""
    return paths.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("name")).where("name <> ''").distinct().orderBy("name")


def whole_files(paths: DataFrame, active: DataFrame, per_theme: int, name: str = "gen_full.mid") -> DataFrame:
    """The files of whole generated pieces, which have no chunk, of active themes and of the samples asked for."""
    found = file_parts(paths).where(F.col("path").endswith(f"/{name}") & F.col("sample_idx").isNotNull() & (F.col("sample_idx") < per_theme))
    return found.join(active.select("theme").distinct(), "theme", "left_semi").drop("chunk_idx")


def generated_files(paths: DataFrame, active: DataFrame, per_theme: int) -> DataFrame:
    """Files of active themes and of the samples asked for, with theme, model, sample and chunk."""
    found = file_parts(paths).where(F.col("sample_idx").isNotNull() & F.col("chunk_idx").isNotNull() & (F.col("sample_idx") < per_theme))
    return found.join(active.select("theme").distinct(), "theme", "left_semi")


def piece_status(wanted: DataFrame, parsed: DataFrame) -> DataFrame:
    """(name, status, pitches) of every wanted piece: missing, parse_error, too_short or ok.

    Training takes the pieces that are ok and reports the others; nothing is dropped unseen.
    """
    note = F.struct("seq_no", "pitch")
    got = parsed.groupBy("name").agg(F.max(F.col("error").isNotNull()).alias("_bad"), F.sort_array(F.collect_list(F.when(F.col("pitch").isNotNull(), note))).alias("_notes"))
    met = wanted.select("name").distinct().join(got, "name", "left")
    status = F.when(F.col("_notes").isNull(), "missing").when(F.col("_bad"), "parse_error").when(F.size("_notes") < LEAST_NOTES, "too_short").otherwise("ok")
    return met.select("name", status.alias("status"), F.when(status == "ok", F.col("_notes.pitch")).alias("pitches"))


def observed_status(wanted: DataFrame, parsed: DataFrame) -> tuple[DataFrame, Observation]:
    """``piece_status`` of the pieces that are ok, and an observation of how many were not, and why.

    The counts are taken as the rows go by: whatever reads the pieces fills the observation, without a job of
    its own. Its numbers are there when the first action over the pieces has ended.
    """
    seen = Observation(f"pieces-{uuid.uuid4().hex}")
    count = lambda status: F.count(F.when(F.col("status") == status, 1)).alias(status)
    held = piece_status(wanted, parsed).observe(seen, *[count(s) for s in STATUSES])
    return held.where("status = 'ok'"), seen


def generated_intervals(wanted: DataFrame, parsed: DataFrame) -> DataFrame:
    """(name, intervals) of every wanted piece: one that cannot be read or is too short keeps an empty list, as it counts."""
    held = piece_status(wanted, parsed)
    empty = F.array().cast("array<int>")
    return held.select("name", F.when(F.col("status") == "ok", music.intervals(F.col("pitches")).cast("array<int>")).otherwise(empty).alias("intervals"))


def real_chunks(measures: DataFrame, notes: DataFrame, size: int) -> DataFrame:
    """Notes of the first part that has any, in chunks of so many bars; chunks without notes do not appear."""
    melody = notes.groupBy("piece_id").agg(F.min("part_no").alias("part_no"))
    bars = bar_chunks(measures.join(melody, ["piece_id", "part_no"], "left_semi"), size)
    return notes.join(bars.select("piece_id", "part_no", "measure_no", "chunk", "offset_in_chunk_q"), ["piece_id", "part_no", "measure_no"])


def full_solos(measures: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of the first part that has any, without pickups; pieces without notes do not appear."""
    melody = notes.groupBy("piece_id").agg(F.min("part_no").alias("part_no"))
    bars = measures.where("measure_no > 0 and coalesce(padding_left, 0) = 0").select("piece_id", "part_no", "measure_no")
    return notes.join(bars.join(melody, ["piece_id", "part_no"], "left_semi"), ["piece_id", "part_no", "measure_no"])


def valid_candidates(df: DataFrame, key: str, k: int, valid: Column, seed: int, spare: int = 3) -> DataFrame:
    """``k`` valid rows out of the first ``k * spare`` of a seeded draw, bad ones replaced by the next; too few are an error."""
    drawn = df.withColumn("_draw", draw_key(seed, F.col(key))).orderBy("_draw", key).limit(k * spare)
    got = drawn.where(valid).orderBy("_draw", key).limit(k)
    # The count stands beside the k rows at most, and beside none, so that none is an error too.
    met = got.agg(F.count(F.lit(1)).alias("_n")).join(got, F.lit(True), "left")
    enough = F.when(F.col("_n") < k, F.raise_error(F.lit(f"fewer than {k} valid candidates")).cast("boolean")).otherwise(True)
    return met.withColumn("_n", enough).where("_n").select(*df.columns)


def backfill_status(wanted: DataFrame, written: DataFrame, chunks: DataFrame, parsed: DataFrame, by: list[str], chunk: list[str]) -> DataFrame:
    """(by, status) of every file to fill in: skipped where it is there, else missing_theme_chunk, midi_load_failed or written.

    ``parsed`` has ``by`` and an error; ``chunks`` the theme chunks that exist, keyed by ``chunk``.
    """
    there = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    met = wanted.join(there(written, by, "_written"), by, "left").join(there(chunks, chunk, "_chunk"), chunk, "left")
    met = met.join(there(parsed.where("error is null"), by, "_loaded"), by, "left")
    status = F.when(F.col("_written"), "skipped").when(F.col("_chunk").isNull(), "missing_theme_chunk").when(F.col("_loaded").isNull(), "midi_load_failed").otherwise("written")
    return met.select(*by, status.alias("status"))
