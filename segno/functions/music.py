"""Column functions on pitches, durations, chords and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_BPM = 120.0
BEATS_PER_BAR = 4

#: Chord tones above the root by chord kind (fixed values).
CHORD_TONES = {
    "major": (0, 4, 7),
    "minor": (0, 3, 7),
    "augmented": (0, 4, 8),
    "diminished": (0, 3, 6),
    "dominant": (0, 4, 7, 10),
    "dominant-seventh": (0, 4, 7, 10),
    "major-seventh": (0, 4, 7, 11),
    "minor-seventh": (0, 3, 7, 10),
    "diminished-seventh": (0, 3, 6, 9),
    "augmented-seventh": (0, 4, 8, 10),
    "half-diminished": (0, 3, 6, 10),
    "major-minor": (0, 3, 7, 11),
    "major-sixth": (0, 4, 7, 9),
    "minor-sixth": (0, 3, 7, 9),
    "dominant-ninth": (0, 2, 4, 7, 10),
    "major-ninth": (0, 2, 4, 7, 11),
    "minor-ninth": (0, 2, 3, 7, 10),
    "dominant-13th": (0, 2, 4, 5, 7, 9, 10),
    "minor-11th": (0, 2, 3, 5, 7, 10),
    "major-13th": (0, 2, 4, 5, 7, 9, 11),
    "suspended-second": (0, 2, 7),
    "suspended-fourth": (0, 5, 7),
}

#: Scale steps above the root (fixed values).
SCALES = {
    "major": (0, 2, 4, 5, 7, 9, 11),
    "dorian": (0, 2, 3, 5, 7, 9, 10),
    "mixolydian": (0, 2, 4, 5, 7, 9, 10),
    "locrian": (0, 1, 3, 5, 6, 8, 10),
    "whole-half": (0, 2, 3, 5, 6, 8, 9, 11),
    "whole-tone": (0, 2, 4, 6, 8, 10),
}

#: The scale that goes with a chord kind; any other kind takes the major scale (fixed values).
KIND_SCALE = {
    "major": "major",
    "major-seventh": "major",
    "major-sixth": "major",
    "major-ninth": "major",
    "minor": "dorian",
    "minor-seventh": "dorian",
    "minor-ninth": "dorian",
    "minor-sixth": "dorian",
    "dominant": "mixolydian",
    "dominant-seventh": "mixolydian",
    "dominant-ninth": "mixolydian",
    "dominant-13th": "mixolydian",
    "half-diminished": "locrian",
    "diminished": "whole-half",
    "diminished-seventh": "whole-half",
    "augmented": "whole-tone",
    "suspended-fourth": "mixolydian",
    "suspended-second": "major",
}

#: Note-length classes in 96ths of a bar (fixed values).
LENGTH_CLASSES = (96, 48, 24, 12, 6, 72, 36, 18, 9, 32, 16, 8)


def pitch_class(pitch: Column) -> Column:
    return F.pmod(pitch.cast("int"), F.lit(12))


def seconds_to_quarters(seconds: Column, bpm: Column | None = None) -> Column:
    """Quarter notes at a tempo; 120 where there is none."""
    return seconds * F.coalesce(bpm, F.lit(DEFAULT_BPM)) / 60 if bpm is not None else seconds * DEFAULT_BPM / 60


def bar_seconds(bpm: Column, numerator: Column, denominator: Column) -> Column:
    return F.lit(60.0) / F.coalesce(bpm, F.lit(DEFAULT_BPM)) * F.coalesce(numerator, F.lit(4)) * (F.lit(4.0) / F.coalesce(denominator, F.lit(4)))


def half_even(x: Column) -> Column:
    """Rounding to whole numbers, halves to the even neighbour."""
    return F.rint(x).cast("int")


def clipped(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def beats(duration: Column, beat: Column) -> Column:
    """A duration in beats; null for a beat of no length."""
    return F.try_divide(duration, beat)


def percent_outside(total: Column, shown: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise((total - shown) * F.lit(100.0) / total)


def key_number(tonic: Column, mode: Column) -> Column:
    """0-11 for major keys, 12-23 for minor ones."""
    return tonic + F.when(mode == "minor", 12).otherwise(0)


def transposition(tonic: Column, mode: Column) -> Column:
    """Semitones from a key to C major or A minor, between -6 and +5."""
    target = F.when(mode == "minor", F.lit(9)).otherwise(F.lit(0))
    up = F.pmod(target - tonic, F.lit(12))
    return F.when(up > 5, up - 12).otherwise(up)


def snapped_grid(offset: Column) -> Column:
    """An offset in quarters on the sixteenth or the triplet grid, whichever is nearer."""
    straight, triplet = F.rint(offset * 4) / 4, F.rint(offset * 3) / 3
    return F.when(F.abs(triplet - offset) < F.abs(straight - offset), triplet).otherwise(straight)


# --- sequences held as arrays -------------------------------------------------------------------


def intervals(pitches: Column) -> Column:
    """Differences of neighbours; empty for fewer than two."""
    n = F.size(pitches)
    body = F.zip_with(F.slice(pitches, 2, F.greatest(n - 1, F.lit(0))), F.slice(pitches, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(n >= 2, body).otherwise(F.slice(pitches, 1, 0))


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` items; empty when there are fewer, null for null."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).when(items.isNotNull(), F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(items, k, n))


def set_overlap(own: Column, other: Column) -> Column:
    """Share of one's distinct items that the other has: null without a reference or own items."""
    mine = F.array_distinct(own)
    return (
        F.when(other.isNull() | (F.size(mine) <= 0), F.lit(None).cast("double"))
        .when(F.size(other) == 0, F.lit(0.0))
        .otherwise(F.size(F.array_intersect(mine, other)).cast("double") / F.size(mine))
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def to_unit_sum(values: Column) -> Column:
    """Values divided by their sum; null where the sum is zero."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(values, lambda x: x / total))


def dense(counts: Column, size: int) -> Column:
    """A map from index to count as an array of doubles."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at(counts, k), F.lit(0)).cast("double"))


def length_class(length: Column, bar: Column) -> Column:
    """The nearest note-length class, the first of equals."""
    gaps = F.array(*[F.abs(length - F.lit(float(c)) * bar / F.lit(96.0)) for c in LENGTH_CLASSES])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


# --- chord tables -------------------------------------------------------------------------------


def chord_kinds(spark: SparkSession) -> DataFrame:
    """(kind, tones, steps): chord tones and scale steps above the root; a row per known kind."""
    rows = [(k, list(t), list(SCALES[KIND_SCALE.get(k, "major")])) for k, t in CHORD_TONES.items()]
    return spark.createDataFrame(rows, "kind string, tones array<int>, steps array<int>")


def with_pitch_classes(chords: DataFrame) -> DataFrame:
    """Chords with ``pcs`` and ``scale_pcs``: unknown kinds count as major, a null root has no notes."""
    known = F.broadcast(chord_kinds(chords.sparkSession))  # a fixed table
    major = F.array(*[F.lit(x) for x in SCALES["major"]])
    triad = F.array(*[F.lit(x) for x in CHORD_TONES["major"]])
    above = lambda a: F.transform(a, lambda x: F.pmod(x + F.col("root_pc"), F.lit(12)))
    out = chords.join(known, "kind", "left")
    pcs, scale = F.coalesce("tones", triad), F.coalesce("steps", major)
    none = F.array().cast("array<int>")
    return out.select(
        *chords.columns,
        F.when(F.col("root_pc").isNull(), none).otherwise(above(pcs)).alias("pcs"),
        F.when(F.col("root_pc").isNull(), none).otherwise(above(scale)).alias("scale_pcs"),
    )


def places(x: Column, n: int) -> Column:
    """A double as text with ``n`` places, rounded from its exact binary value, ties to even.

    Twice the scaled value tells a tie by being odd; what the product lost in rounding tells on which side
    of the tie the number is. From 1e9 on, places are those of the shortest decimal of the double.
    """
    twice = float(2 * 10**n)
    product = x * twice
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the digits: both products are exact
    lost = (high * twice - product) + (x - high) * twice
    tie = (product == F.floor(product)) & (F.pmod(product, F.lit(2.0)) == 1.0)
    near = F.when(tie & (lost > 0), (product + 1) / 2).when(tie & (lost < 0), (product - 1) / 2).when(tie, F.rint(product / 2)).otherwise(F.floor(product / 2 + 0.5).cast("double"))
    text = F.format_string(f"%.{n}f", near / float(10**n))
    signed = F.when((x < 0) & (near == 0), F.concat(F.lit("-"), F.format_string(f"%.{n}f", F.lit(0.0)))).otherwise(text)
    return F.when(F.abs(x) < 1e9, signed).otherwise(F.format_string(f"%.{n}f", x))
