"""Metrics of generated segments, their two-level means and summary.

A segment is named by SEGMENT. ``notes`` has a row per note with pitch, start_s and end_s; ``chords``
a row per chord of a theme's chunk with offset_q, pcs and scale_pcs; ``melodies`` the theme's pitches
as an array. Ratios are null where nothing can be counted; note density is then zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segno.functions import music

from .relational import asof_join, eight_numbers, near_downbeat

SEGMENT = ["theme", "model", "sample_idx", "chunk_idx"]
METRICS = [
    "ctr", "ctr_first_beat", "chord_match_per_time", "scale_match", "scale_match_per_time", "note_density", "pitch_entropy",
    "ngram_3_overlap", "ngram_4_overlap", "ngram_5_overlap",
]


def _share(hit: Column, among: Column) -> Column:
    return F.try_divide(F.sum(F.when(among & hit, 1).otherwise(0)).cast("double"), F.sum(F.when(among, 1).otherwise(0)))


def _weighted(hit: Column, among: Column, weight: Column) -> Column:
    total = F.sum(F.when(among, weight).otherwise(0.0))
    return F.when(total > 0, F.sum(F.when(among & hit, weight).otherwise(0.0)) / total)


def chord_metrics(notes: DataFrame, chords: DataFrame, bpm: float = 120.0) -> DataFrame:
    """The five chord metrics from one as-of join and one aggregation."""
    placed = notes.withColumn("at_q", music.seconds_to_quarters(F.col("start_s"), F.lit(bpm)))
    # Every segment of a theme's chunk reads the same chords: they are joined on the chunk.
    met = asof_join(placed, chords, ["theme", "chunk_idx"], "at_q", "offset_q", "seq_no", "chord")
    last = met.groupBy(*SEGMENT).agg(F.max("end_s").alias("last_s"))
    met = met.join(last, SEGMENT)
    pc = music.pitch_class(F.col("pitch"))
    there = F.col("chord").isNotNull()
    rooted = there & (F.size("chord.scale_pcs") > 0)
    tone, step = F.array_contains("chord.pcs", pc), F.array_contains("chord.scale_pcs", pc)
    length = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    first = near_downbeat(F.col("start_s"), F.lit(4 * 60.0 / bpm), F.col("last_s"), F.lit(60.0 / bpm / 16))
    return met.groupBy(*SEGMENT).agg(
        _share(tone, there).alias("ctr"),
        _share(tone, there & first).alias("ctr_first_beat"),
        _weighted(tone, there, length).alias("chord_match_per_time"),
        _share(step, rooted).alias("scale_match"),
        _weighted(step, rooted, length).alias("scale_match_per_time"),
    )


def note_density(segments: DataFrame, notes: DataFrame, bars: int = 8) -> DataFrame:
    """Notes a bar; segments without notes have zero."""
    counts = notes.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    out = segments.select(*SEGMENT).join(counts, SEGMENT, "left").withColumn("n_notes", F.coalesce("_n", F.lit(0)))
    return out.select(*SEGMENT, "n_notes", (F.col("n_notes") / F.lit(float(bars))).alias("note_density"))


def pitch_entropy(notes: DataFrame) -> DataFrame:
    """Entropy of pitch classes in bits."""
    counts = notes.groupBy(*SEGMENT, music.pitch_class(F.col("pitch")).alias("pc")).agg(F.count(F.lit(1)).alias("n"))
    # From counts: log2 N - sum(n log2 n) / N.
    out = counts.groupBy(*SEGMENT).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return out.select(*SEGMENT, F.greatest(F.log2(F.col("all").cast("double")) - F.col("s") / F.col("all"), F.lit(0.0)).alias("pitch_entropy"))


def pitch_sequences(notes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The pitches of each group in order, as an array."""
    held = notes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col("pitch").alias("_p")))).alias("_s"))
    return held.select(*by, F.transform("_s", lambda x: x["_p"]).alias("pitches"))


def theme_overlap(notes: DataFrame, melodies: DataFrame, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Shares of a segment's distinct interval n-grams that its theme has."""
    own = pitch_sequences(notes, SEGMENT, ["start_s", "seq_no"]).withColumn("own", music.intervals(F.col("pitches"))).drop("pitches")
    met = own.join(melodies.select("theme", "chunk_idx", music.intervals(F.col("melody")).alias("theirs")), ["theme", "chunk_idx"], "left")
    return met.select(*SEGMENT, *[music.set_overlap(music.ngrams(F.col("own"), n), music.ngrams(F.col("theirs"), n)).alias(f"ngram_{n}_overlap") for n in sizes])


def per_segment(segments: DataFrame, notes: DataFrame, chords: DataFrame, melodies: DataFrame, bars: int = 8) -> DataFrame:
    """A row per segment with its number of notes and all metrics, rounded to six places."""
    out = note_density(segments, notes, bars)
    for part in (chord_metrics(notes, chords), pitch_entropy(notes), theme_overlap(notes, melodies)):
        out = out.join(part, SEGMENT, "left")
    return out.select(*SEGMENT, F.col("n_notes").cast("long").alias("n_notes"), *[F.round(m, 6).alias(m) for m in METRICS])


def theme_means(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(model, theme, metric, value): means over samples and chunks; text that is no number, and NaN, count as missing."""
    metrics = metrics or METRICS
    means = rows.groupBy("model", "theme").agg(*[F.avg(F.when(~F.isnan(F.col(m).try_cast("double")), F.col(m).try_cast("double"))).alias(m) for m in metrics])
    return means.unpivot(["model", "theme"], metrics, "metric", "value")


def aggregates(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Eight numbers over themes for each model and metric, also where no theme has a value."""
    return eight_numbers(theme_means(rows, metrics), ["model", "metric"], "value").withColumnRenamed("n", "n_themes")
