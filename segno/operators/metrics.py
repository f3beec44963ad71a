"""Metrics of segments that can be plugged in, compiled into one aggregation.

A metric names the parts it needs, each an aggregate over a segment's notes, and says how its value comes
from them. All parts of all asked metrics are computed in one pass: notes meet their chords by one as-of
join, and one aggregation gives every part once, however many metrics read it. A metric that is added is
a few more columns of that aggregation, never another pass.

    add_part("mean_pitch_sum", lambda n: F.avg(n.pitch))
    add(Metric("mean_pitch", ("mean_pitch_sum",), lambda p: p["mean_pitch_sum"]))
    per_segment(segments, notes, chords, melodies, names=[*METRICS, "mean_pitch"])
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.functions import music

from .relational import asof_join, near_downbeat
from .segment_metrics import SEGMENT


class Note:
    """What a part can read of a note: its columns, the chord that holds, and what follows from both."""

    def __init__(self, bpm: float):
        self.pitch, self.start, self.end, self.seq_no = F.col("pitch"), F.col("start_s"), F.col("end_s"), F.col("seq_no")
        self.pitch_class = music.pitch_class(self.pitch)
        self.length = F.greatest(self.end - self.start, F.lit(0.0))
        self.there = F.col("chord").isNotNull()
        self.rooted = self.there & (F.size("chord.scale_pcs") > 0)
        self.tone = F.array_contains("chord.pcs", self.pitch_class)
        self.step = F.array_contains("chord.scale_pcs", self.pitch_class)
        self.first = near_downbeat(self.start, F.lit(4 * 60.0 / bpm), F.col("last_s"), F.lit(60.0 / bpm / 16))


@dataclass(frozen=True)
class Metric:
    """``value`` gets the asked parts by name; ``none`` stands where a segment has no note."""

    name: str
    needs: tuple[str, ...]
    value: Callable[[dict[str, Column]], Column]
    none: float | None = None


#: Aggregates over a segment's notes, by name; MELODY and BARS are not aggregated but stand beside them.
PARTS: dict[str, Callable[[Note], Column]] = {}
REGISTRY: dict[str, Metric] = {}
MELODY, BARS = "theirs", "bars"


def add_part(name: str, make: Callable[[Note], Column]) -> None:
    if name in PARTS or name in (MELODY, BARS):
        raise ValueError(f"a part is named {name} already")
    PARTS[name] = make


def add(metric: Metric) -> Metric:
    if metric.name in REGISTRY:
        raise ValueError(f"a metric is named {metric.name} already")
    if missing := [p for p in metric.needs if p not in PARTS and p not in (MELODY, BARS)]:
        raise ValueError(f"{metric.name} needs {', '.join(missing)}, which no part is")
    REGISTRY[metric.name] = metric
    return metric


def _count(when: Column) -> Column:
    return F.sum(F.when(when, 1).otherwise(0)).cast("double")


def _length(when: Column, n: Note) -> Column:
    return F.sum(F.when(when, n.length).otherwise(0.0))


def _ratio(over: str, under: str) -> Callable[[dict[str, Column]], Column]:
    return lambda p: F.when(p[under] > 0, p[over] / p[under])


def _entropy(p: dict[str, Column]) -> Column:
    """In bits, from counts: log2 N - sum(n log2 n) / N."""
    terms = reduce(lambda a, b: a + b, [F.when(p[f"pc{k}"] > 0, p[f"pc{k}"] * F.log2(p[f"pc{k}"])).otherwise(0.0) for k in range(12)])
    return F.when(p["notes"] > 0, F.greatest(F.log2(p["notes"]) - terms / p["notes"], F.lit(0.0)))


def _overlap(n: int) -> Callable[[dict[str, Column]], Column]:
    own = lambda p: music.intervals(F.transform(p["sequence"], lambda x: x["pitch"]))
    return lambda p: F.when(p["sequence"].isNotNull(), music.set_overlap(music.ngrams(own(p), n), music.ngrams(p[MELODY], n)))


def _standard() -> None:
    add_part("notes", lambda n: F.count(F.lit(1)).cast("double"))
    add_part("on_chord", lambda n: _count(n.there))
    add_part("tones", lambda n: _count(n.there & n.tone))
    add_part("first_on_chord", lambda n: _count(n.there & n.first))
    add_part("first_tones", lambda n: _count(n.there & n.first & n.tone))
    add_part("chord_s", lambda n: _length(n.there, n))
    add_part("tone_s", lambda n: _length(n.there & n.tone, n))
    add_part("on_scale", lambda n: _count(n.rooted))
    add_part("steps", lambda n: _count(n.rooted & n.step))
    add_part("scale_s", lambda n: _length(n.rooted, n))
    add_part("step_s", lambda n: _length(n.rooted & n.step, n))
    for k in range(12):
        add_part(f"pc{k}", lambda n, k=k: _count(n.pitch_class == k))
    add_part("sequence", lambda n: F.sort_array(F.collect_list(F.struct(n.start.alias("start_s"), n.seq_no.alias("seq_no"), n.pitch.alias("pitch")))))  # a segment's own notes
    add(Metric("ctr", ("tones", "on_chord"), _ratio("tones", "on_chord")))
    add(Metric("ctr_first_beat", ("first_tones", "first_on_chord"), _ratio("first_tones", "first_on_chord")))
    add(Metric("chord_match_per_time", ("tone_s", "chord_s"), _ratio("tone_s", "chord_s")))
    add(Metric("scale_match", ("steps", "on_scale"), _ratio("steps", "on_scale")))
    add(Metric("scale_match_per_time", ("step_s", "scale_s"), _ratio("step_s", "scale_s")))
    add(Metric("note_density", ("notes", BARS), lambda p: p["notes"] / p[BARS], none=0.0))
    add(Metric("pitch_entropy", ("notes", *[f"pc{k}" for k in range(12)]), _entropy))
    for n in (3, 4, 5):
        add(Metric(f"ngram_{n}_overlap", ("sequence", MELODY), _overlap(n)))


_standard()
#: The metrics that stand in the final table.
METRICS = list(REGISTRY)


def per_segment(segments: DataFrame, notes: DataFrame, chords: DataFrame, melodies: DataFrame, bars: int = 8, names: list[str] | None = None, bpm: float = 120.0) -> DataFrame:
    """A row per segment with its number of notes and the asked metrics, rounded to six places."""
    asked = [REGISTRY[n] for n in (names or METRICS)]
    parts = list(dict.fromkeys(["notes", *[p for m in asked for p in m.needs if p in PARTS]]))
    placed = notes.withColumn("at_q", music.seconds_to_quarters(F.col("start_s"), F.lit(bpm)))
    # Every segment of a theme's chunk reads the same chords: they are joined on the chunk.
    met = asof_join(placed, chords, ["theme", "chunk_idx"], "at_q", "offset_q", "seq_no", "chord")
    met = met.withColumn("last_s", F.max("end_s").over(Window.partitionBy(*SEGMENT)))  # dealt as the aggregation is
    note = Note(bpm)
    held = met.groupBy(*SEGMENT).agg(*[PARTS[p](note).alias(f"part_{p}") for p in parts])
    out = segments.select(*SEGMENT).join(held, SEGMENT, "left")
    if any(MELODY in m.needs for m in asked):
        theirs = melodies.select("theme", "chunk_idx", music.intervals(F.col("melody")).alias(MELODY))
        out = out.join(theirs, ["theme", "chunk_idx"], "left")
    known = {p: F.col(f"part_{p}") for p in parts} | {MELODY: F.col(MELODY), BARS: F.lit(float(bars))}
    values = [F.round(F.coalesce(m.value(known), F.lit(m.none).cast("double")), 6).alias(m.name) for m in asked]
    return out.select(*SEGMENT, F.coalesce("part_notes", F.lit(0)).cast("long").alias("n_notes"), *values)
