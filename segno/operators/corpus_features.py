"""Nine features of pieces, as vectors in long form (piece columns, feature, vec).

``notes`` has a row per note with instr, seq_no, pitch, velocity, start_s and end_s; ``pieces`` the
tempo and meter. A feature that a piece lacks has no row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.functions import music
from segno.shipping import ship_package

Maker = Callable[[DataFrame, DataFrame, list[str]], DataFrame]

FEATURES = [
    "total_used_pitch", "total_used_note", "pitch_range", "avg_pitch_interval", "avg_ioi",
    "total_pitch_class_histogram", "pitch_class_transition_matrix", "note_length_hist", "note_length_transition_matrix",
]
FRAMES_PER_SECOND = 100
TRANSITION_GAP = 0.05


def _bars(pieces: DataFrame, by: list[str]) -> DataFrame:
    return pieces.select(*by, music.bar_seconds(F.col("tempo_bpm"), F.col("ts_num"), F.col("ts_den")).alias("bar_s"))


def scalar_features(notes: DataFrame, by: list[str]) -> DataFrame:
    """Used pitches, notes, range, mean absolute interval and mean inter-onset time, in one pass.

    The range takes the first instrument's notes that sound in a frame of 10 ms.
    """
    line = Window.partitionBy(*by).orderBy("start_s", "pitch", "seq_no")
    steps = notes.withColumn("step", F.abs(F.col("pitch") - F.lag("pitch").over(line)))
    frames = F.floor(F.col("end_s") * FRAMES_PER_SECOND) - F.floor(F.col("start_s") * FRAMES_PER_SECOND)
    heard = F.when((F.col("instr") == 0) & (frames > 0), F.col("pitch"))
    n = F.count(F.lit(1))
    got = steps.groupBy(*by).agg(
        F.count_distinct("pitch").cast("double").alias("total_used_pitch"),
        n.cast("double").alias("total_used_note"),
        (F.max(heard) - F.min(heard)).cast("double").alias("pitch_range"),
        F.when(n >= 2, F.avg("step")).alias("avg_pitch_interval"),
        F.when(n >= 2, (F.max("start_s") - F.min("start_s")) / (n - 1)).alias("avg_ioi"),
    )
    long = got.unpivot(by, FEATURES[:5], "feature", "x").where("x is not null")
    return long.select(*by, "feature", F.array("x").alias("vec"))


def _vectors(counts: DataFrame, by: list[str], size: int, feature: str, unit: bool) -> DataFrame:
    """Counts (by, cell, n) as dense vectors."""
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    vec: Column = music.dense(F.col("m"), size)
    vec = music.to_unit_sum(vec) if unit else vec
    return held.select(*by, F.lit(feature).alias("feature"), vec.alias("vec")).where("vec is not null")


def pitch_class_histogram(notes: DataFrame, by: list[str]) -> DataFrame:
    """Shares of pitch classes, weighted by velocity and sounding frames of the first instrument."""
    frames = F.floor(F.col("end_s") * FRAMES_PER_SECOND) - F.floor(F.col("start_s") * FRAMES_PER_SECOND)
    weighed = notes.where("instr = 0").select(*by, music.pitch_class(F.col("pitch")).alias("cell"), (F.col("velocity") * F.greatest(frames, F.lit(0))).alias("w"))
    return _vectors(weighed.groupBy(*by, "cell").agg(F.sum("w").alias("n")), by, 12, "total_pitch_class_histogram", unit=True)


def pitch_class_transitions(notes: DataFrame, by: list[str]) -> DataFrame:
    """Counts of pitch-class pairs where one note ends within 50 ms of another's onset."""
    from .relational import band_self_join

    known = notes.select(*by, "seq_no", "start_s", "end_s", music.pitch_class(F.col("pitch")).alias("pc"))
    pairs = band_self_join(known, by, "end_s", "start_s", TRANSITION_GAP, "seq_no")
    counts = pairs.groupBy(*by, (F.col("a.pc") * 12 + F.col("b.pc")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    met = _vectors(counts, by, 144, "pitch_class_transition_matrix", unit=False)
    none = F.array_repeat(F.lit(0.0), 144)
    several = notes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return several.join(met, by, "left").select(*by, F.lit("pitch_class_transition_matrix").alias("feature"), F.coalesce("vec", none).alias("vec"))


def _with_class(notes: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    known = notes.join(_bars(pieces, by), by)
    return known.withColumn("cell", music.length_class(F.col("end_s") - F.col("start_s"), F.col("bar_s")))


def note_length_features(notes: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    """Shares of note-length classes, and counts of successive classes."""
    classed = _with_class(notes, pieces, by)
    shares = _vectors(classed.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n")), by, 12, "note_length_hist", unit=True)
    line = Window.partitionBy(*by).orderBy("start_s", "pitch", "seq_no")
    moves = classed.withColumn("from", F.lag("cell").over(line)).where("from is not null")
    counts = moves.groupBy(*by, (F.col("from") * 12 + F.col("cell")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return shares.unionByName(_vectors(counts, by, 144, "note_length_transition_matrix", unit=False))


#: What computes features: (notes, pieces, by) -> (by, feature, vec), with the names of the features that it gives.
MAKERS: list[tuple[tuple[str, ...], Maker]] = [
    (tuple(FEATURES[:5]), lambda notes, pieces, by: scalar_features(notes, by)),
    (("total_pitch_class_histogram",), lambda notes, pieces, by: pitch_class_histogram(notes, by)),
    (("pitch_class_transition_matrix",), lambda notes, pieces, by: pitch_class_transitions(notes, by)),
    (("note_length_hist", "note_length_transition_matrix"), note_length_features),
]


def add_feature(name: str, vector: Callable[[dict[str, np.ndarray]], list[float] | None]) -> None:
    """A feature that a function of one piece gives: its notes as arrays (pitch, velocity, start_s, end_s) in order
    of start and pitch. None stands for a piece that lacks it. Pieces are dealt to tasks; a task holds one at a time."""
    if any(name in names for names, _ in MAKERS):
        raise ValueError(f"a feature is named {name} already")
    fields = ["pitch", "velocity", "start_s", "end_s"]

    def make(notes: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
        ship_package(notes.sparkSession)

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([(c, "ascending") for c in ("start_s", "pitch", "seq_no")])
            vec = vector({c: rows.column(c).to_numpy() for c in fields})
            held = rows.slice(0, 0 if vec is None else 1).select(by)
            return held.append_column("feature", pa.array([name] * len(held))).append_column("vec", pa.array([[float(x) for x in vec]] * len(held) if vec is not None else [], pa.list_(pa.float64())))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.select(*by).schema)
        return notes.select(*by, "seq_no", *fields).groupBy(*by).applyInArrow(run, f"{schema}, feature string, vec array<double>")

    MAKERS.append(((name,), make))


def all_features(notes: DataFrame, pieces: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """The asked features of all pieces; the nine of the library unless others are named. What makes none is not run."""
    asked = set(FEATURES if names is None else names)
    if unknown := asked - {n for given, _ in MAKERS for n in given}:
        raise ValueError(f"no feature is named {', '.join(sorted(unknown))}")
    parts = [make(notes, pieces, by) for given, make in MAKERS if asked & set(given)]
    return reduce(DataFrame.unionByName, parts).where(F.col("feature").isin(*asked))
