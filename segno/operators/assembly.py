"""Scores from notes in seconds: a grid for each quarter, clean lengths, measures, and chords repeated under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .domain import quarter_snapped

#: Quarters of a bar (a fixed value: all pieces are in 4/4).
BAR_Q = 4


def melody_line(notes: DataFrame, by: list[str], bpm: Column) -> DataFrame:
    """(by, seq_no, pitch, offset_q, length_q): notes (start_s, end_s) on the grids of the quarters they begin and end in.

    A quarter is divided in three or in four, by the onsets and ends within it. A note is a step of its quarter
    long at least. Notes of one voice: a note ends where the next begins, and of notes that begin together the
    highest stays. ``seq_no`` tells the notes of a piece apart.
    """
    # Seconds are not exact: places are read to a millionth before they are put into quarters.
    place = lambda c: F.round(F.col(c) * bpm / 60, 6)
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("ends"), place(c).alias("offset_q")) for k, c in enumerate(("start_s", "end_s"))])).alias("x")
    placed = quarter_snapped(notes.select(*by, "seq_no", "pitch", ends).select(*by, "seq_no", "pitch", "x.*"), by)
    at = lambda k, c: F.max(F.when(F.col("ends") == k, F.col(c)))
    both = placed.groupBy(*by, "seq_no", "pitch").agg(at(0, "snapped_q").alias("offset_q"), at(1, "snapped_q").alias("_end"), at(0, "grid").alias("_grid"))
    both = both.withColumn("_end", F.greatest("_end", F.col("offset_q") + 1 / F.col("_grid")))
    one = both.groupBy(*by, "offset_q").agg(F.max_by(F.struct("seq_no", "pitch", "_end"), F.struct("pitch", "seq_no")).alias("x")).select(*by, "offset_q", "x.*")
    line = Window.partitionBy(*by).orderBy("offset_q")
    length = F.least(F.col("_end"), F.coalesce(F.lead("offset_q").over(line), F.col("_end"))) - F.col("offset_q")
    return one.select(*by, "seq_no", "pitch", "offset_q", length.alias("length_q"))


def tiled_chords(cycle: Column, total_q: Column, cycle_q: float) -> Column:
    """The chords (offset_q, ...) of a cycle as a sorted array, again in every cycle of a piece that is ``total_q`` long.

    None is placed at or behind the end.
    """
    kinds = ("root_pc", "kind")
    moved = lambda c, k: F.struct((c["offset_q"] + k * cycle_q).alias("offset_q"), *[c[x].alias(x) for x in kinds])
    again = F.transform(F.sequence(F.lit(0), F.floor(total_q / cycle_q).cast("int")), lambda k: F.transform(cycle, lambda c: moved(c, k)))
    return F.filter(F.flatten(again), lambda c: c["offset_q"] < total_q)


def with_chords(line: DataFrame, chords: DataFrame | None, by: list[str], cycle_q: float = 32.0, of: list[str] | None = None) -> DataFrame:
    """(by, notes, chords): each piece's notes and tiled chords as sorted arrays, ready to be written as a score.

    Chords fill all bars that a piece's notes reach. They are repeated within their piece's row. ``of`` names what
    has chords of its own, a piece by default; pieces with equal ones share theirs.
    """
    note = F.struct("offset_q", "seq_no", "length_q", "pitch")
    none = F.array().cast("array<struct<offset_q:double,root_pc:int,kind:string>>")
    end = F.max(F.col("offset_q") + F.col("length_q"))
    total = (F.ceil(end / BAR_Q - 1e-9) * BAR_Q).cast("double")
    held = line.groupBy(*by).agg(F.sort_array(F.collect_list(note)).alias("notes"), total.alias("total_q"))  # a piece's own notes
    if chords is None:
        return held.drop("total_q").withColumn("chords", none)
    chord = F.struct(F.col("offset_q").cast("double").alias("offset_q"), F.col("root_pc").cast("int").alias("root_pc"), "kind")
    first = chords.where("root_pc is not null").where((F.col("offset_q") >= 0) & (F.col("offset_q") < cycle_q))
    of = of or by
    cycles = first.groupBy(*of).agg(F.sort_array(F.collect_list(chord)).alias("cycle"))
    return held.join(cycles, of, "left").select(*by, "notes", F.coalesce(tiled_chords(F.col("cycle"), F.col("total_q"), cycle_q), none).alias("chords"))
