"""Transforms of scores and note lists: cutting, retiming, ties, transposition, patterns and tensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segno.functions import music

from .relational import asof_join, chains, chunk_rows, required_join

EPSILON = 1e-9
#: Rhythm tokens (fixed values).
REST, HOLD, ONSET = 0, 1, 2
#: Beats a minute of a theme that states none (a fixed value).
DEFAULT_BPM = 180.0


# --- scores -------------------------------------------------------------------------------------


def melody_parts(score_notes: DataFrame) -> DataFrame:
    """(piece_id, part_no): the first part with a note."""
    return score_notes.groupBy("piece_id").agg(F.min("part_no").alias("part_no"))


def melody_of(pieces: DataFrame, score_notes: DataFrame) -> DataFrame:
    """(piece_id, part_no) of every piece; one without a note in any part is an error that names it."""
    return required_join(pieces.select("piece_id").distinct(), melody_parts(score_notes), ["piece_id"], "no part with notes in ")


def generated_measures(pieces: DataFrame, measures: DataFrame, score_notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(piece_id, status) of every generated piece, and the measures of the melody of those that are ok.

    A piece without a part with notes, or whose melody has no measure, is skipped and reported.
    """
    melody = melody_parts(score_notes)
    held = measures.join(melody, ["piece_id", "part_no"], "left_semi")
    bars = held.groupBy("piece_id").agg(F.count(F.lit(1)).alias("_bars"))
    met = pieces.select("piece_id").distinct().join(melody, "piece_id", "left").join(bars, "piece_id", "left")
    status = F.when(F.col("part_no").isNull(), "no_melody").when(F.col("_bars").isNull(), "no_measures").otherwise("ok")
    return met.select("piece_id", status.alias("status")), held


def bar_counts(measures: DataFrame) -> DataFrame:
    """(piece_id, bars): numbered measures of the first part."""
    return measures.where("part_no = 0 and measure_no > 0").groupBy("piece_id").agg(F.count(F.lit(1)).alias("bars"))


def bar_chunks(measures: DataFrame, size: int) -> DataFrame:
    """Measures in chunks of ``size``: pickups and a shorter tail are dropped, places count from the chunk's start."""
    kept = measures.where("measure_no > 0 and coalesce(padding_left, 0) = 0")
    cut = chunk_rows(kept, ["piece_id", "part_no"], ["offset_q"], size)
    start = F.min("offset_q").over(Window.partitionBy("piece_id", "part_no", "chunk"))
    return cut.withColumn("offset_in_chunk_q", F.col("offset_q") - start)


def theme_chunks(measures: DataFrame, size: int) -> DataFrame:
    """Like ``bar_chunks``, but a pickup stays with the first chunk; too short themes give no rows."""
    full = bar_chunks(measures, size).select(*measures.columns, "chunk")
    pickup = measures.where("measure_no = 0 or coalesce(padding_left, 0) > 0").withColumn("chunk", F.lit(0))
    return full.unionByName(pickup.join(full.select("piece_id", "part_no").distinct(), ["piece_id", "part_no"], "left_semi"))


def trimmed(measures: DataFrame, bars: int) -> DataFrame:
    """Measures 1 to ``bars`` of pieces that have more measures; others stay as they are, pickups included."""
    sizes = measures.groupBy("piece_id").agg(F.count(F.lit(1)).alias("_n"))
    met = measures.join(sizes, "piece_id")
    return met.where((F.col("_n") <= bars) | F.col("measure_no").between(1, bars)).drop("_n")


# --- note lists ---------------------------------------------------------------------------------


def _placed(notes: DataFrame, window: DataFrame, by: list[str], early: float) -> DataFrame:
    """Notes in the window they start in, moved to its start; they end with it."""
    placed = notes.join(window, by).withColumn("window", F.floor((F.col("start_s") + early) / F.col("win_s")).cast("int"))
    start = F.col("window") * F.col("win_s")
    return placed.withColumn("end_s", F.least(F.col("end_s"), start + F.col("win_s")) - start).withColumn("start_s", F.col("start_s") - start)


def _bar_lengths(notes: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    bar = pieces.select(*by, music.bar_seconds(F.col("tempo_bpm"), F.col("ts_num"), F.col("ts_den")).alias("bar_s"))
    return bar.join(notes.groupBy(*by).agg(F.max("end_s").alias("_end")), by)


def slice_bars(notes: DataFrame, pieces: DataFrame, by: list[str], bars: int) -> DataFrame:
    """Notes cut into windows of so many bars of equal length, counted from 0 and moved to its start.

    Whole windows that the last note's end reaches; windows without notes are left out.
    """
    window = _bar_lengths(notes, pieces, by).withColumn("win_s", F.col("bar_s") * bars)
    window = window.select(*by, "win_s", F.floor((F.col("_end") + 1e-6) / F.col("win_s")).cast("int").alias("_of"))
    return _placed(notes, window, by, 0.0).where(F.col("window") < F.col("_of")).drop("win_s", "_of")


def slice_downbeats(notes: DataFrame, pieces: DataFrame, by: list[str], bars: int) -> DataFrame:
    """Notes cut at every so-manyth downbeat; what lies behind the last whole window goes.

    A piece has the downbeats before its end, and one bar less than downbeats. A note a hair before a
    window belongs to it. Windows without notes stay, with null notes.
    """
    window = _bar_lengths(notes, pieces, by).withColumn("win_s", F.col("bar_s") * bars)
    downbeats = F.ceil(F.col("_end") / F.col("bar_s") - EPSILON)
    window = window.select(*by, "win_s", F.floor(F.greatest(downbeats - 1, F.lit(0)) / bars).cast("int").alias("_of")).where("_of > 0")
    frames = window.select(*by, F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("window"))
    return frames.join(_placed(notes, window.drop("_of"), by, EPSILON).drop("win_s"), [*by, "window"], "left")


def second_half(notes: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    """Notes from the middle downbeat on, moved to its start; pieces with fewer than two downbeats have none."""
    bar = pieces.select(*by, music.bar_seconds(F.col("tempo_bpm"), F.col("ts_num"), F.col("ts_den")).alias("bar_s"))
    ends = notes.groupBy(*by).agg(F.max("end_s").alias("_end"))
    cuts = bar.join(ends, by).withColumn("_downbeats", F.ceil(F.col("_end") / F.col("bar_s"))).where("_downbeats >= 2")
    cuts = cuts.select(*by, (F.floor(F.col("_downbeats") / 2) * F.col("bar_s")).alias("_cut"))
    kept = notes.join(cuts, by).where(F.col("start_s") >= F.col("_cut") - EPSILON)
    return kept.withColumn("end_s", F.col("end_s") - F.col("_cut")).withColumn("start_s", F.greatest(F.col("start_s") - F.col("_cut"), F.lit(0.0))).drop("_cut")


def retempo(notes: DataFrame, current: Column, target: Column) -> DataFrame:
    return notes.withColumn("start_s", F.col("start_s") * current / target).withColumn("end_s", F.col("end_s") * current / target)


def tempo_map(tempos: DataFrame, by: list[str]) -> DataFrame:
    """(by, offset_q, bpm, at_s): tempo changes with the second at which each begins, summed piece by piece.

    ``tempos`` has (by, offset_q, bpm); the first holds from the start of the piece on. Of changes at one place
    the one with the larger bpm counts.
    """
    one = tempos.groupBy(*by, "offset_q").agg(F.max("bpm").alias("bpm"))
    line = Window.partitionBy(*by).orderBy("offset_q")
    one = one.withColumn("offset_q", F.when(F.row_number().over(line) == 1, F.least(F.col("offset_q"), F.lit(0.0))).otherwise(F.col("offset_q")))
    spent = (F.col("offset_q") - F.lag("offset_q").over(line)) * 60 / F.lag("bpm").over(line)
    return one.withColumn("_spent", F.coalesce(spent, F.lit(0.0))).withColumn("at_s", F.sum("_spent").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_spent")


def with_tempi(notes: DataFrame, tempos: DataFrame, by: list[str]) -> DataFrame:
    """Notes (offset_q, length_q) with start_s and end_s under tempi that change within a piece.

    A start and an end each take the tempo that holds at their place: the tempo changes are joined as of both.
    Pieces without a tempo go at DEFAULT_BPM.
    """
    known = tempo_map(tempos, by).withColumn("_tie", F.lit(0))
    placed = notes.withColumn("_end_q", F.col("offset_q") + F.col("length_q"))
    for place, out in (("offset_q", "start_s"), ("_end_q", "end_s")):
        met = asof_join(placed, known, by, place, "offset_q", "_tie", "_tempo")
        second = F.coalesce(F.col("_tempo.at_s"), F.lit(0.0)) + (F.col(place) - F.coalesce(F.col("_tempo.offset_q"), F.lit(0.0))) * 60 / F.coalesce(F.col("_tempo.bpm"), F.lit(DEFAULT_BPM))
        placed = met.withColumn(out, second).drop("_tempo")
    return placed.drop("_end_q")


def score_state(notes: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    """What a written piece carries: tempo, key number, 4/4, and the piano for every instrument.

    ``pieces`` has ``by`` and bpm (null: DEFAULT_BPM); the key is the one that fits the notes' pitch classes best.
    """
    from .corpus_features import pitch_class_histogram

    found = keys(pitch_class_histogram(notes, by), by)
    number = music.key_number(F.col("tonic"), F.col("mode")).alias("key_number")
    met = pieces.select(*by, F.coalesce("bpm", F.lit(DEFAULT_BPM)).alias("bpm")).join(found, by, "left")
    return met.select(*by, "bpm", number, F.lit(4).alias("ts_num"), F.lit(4).alias("ts_den"), F.lit(0).alias("program"), F.lit("Piano").alias("instrument"))


def to_seconds(notes: DataFrame, bpm: Column) -> DataFrame:
    """Score places and lengths in quarters as seconds."""
    return notes.withColumn("start_s", F.col("offset_q") * 60 / bpm).withColumn("end_s", (F.col("offset_q") + F.col("length_q")) * 60 / bpm)


def transposed(notes: DataFrame, semitones: Column) -> DataFrame:
    return notes.withColumn("pitch", F.col("pitch") + semitones)


def cyclic_chords(chords: DataFrame, by: list[str], cycle_q: float, total_q: float) -> DataFrame:
    """Chords repeated every cycle, as far as the total reaches."""
    repeats = F.explode(F.sequence(F.lit(0), F.lit(int(total_q // cycle_q)))).alias("_k")
    out = chords.where(F.col("offset_q") < cycle_q).select("*", repeats).withColumn("offset_q", F.col("offset_q") + F.col("_k") * cycle_q)
    return out.where(F.col("offset_q") < total_q).drop("_k")


def quarter_snapped(notes: DataFrame, by: list[str]) -> DataFrame:
    """Notes at ``snapped_q``, with the ``grid`` of their quarter: triplets where its onsets lie nearer to them in sum, else sixteenths."""
    quarter = notes.withColumn("_quarter", F.floor("offset_q"))
    off = F.col("offset_q") - F.col("_quarter")
    gap = lambda n: F.abs(off - F.rint(off * n) / n)
    within = Window.partitionBy(*by, "_quarter")
    sums = lambda n: F.round(F.sum(gap(n)).over(within), 9)
    met = quarter.withColumns({"_straight": sums(4), "_triplet": sums(3)}).withColumn("grid", F.when(F.col("_triplet") < F.col("_straight"), 3).otherwise(4))
    return met.withColumn("snapped_q", F.col("_quarter") + F.rint(off * F.col("grid")) / F.col("grid")).drop("_quarter", "_straight", "_triplet")


def melody_measures(notes: DataFrame, bar_q: float = 4.0) -> DataFrame:
    """Notes (offset_q, length_q) cut at barlines: measure_no from 1, place in the measure, and ties between the parts."""
    end = F.col("offset_q") + F.col("length_q")
    first, last = F.floor(F.col("offset_q") / bar_q), F.ceil(end / bar_q) - 1
    cut = notes.where("length_q > 0").select("*", F.explode(F.sequence(first, last)).alias("_bar"), first.alias("_first"), last.alias("_last"))
    start = F.greatest(F.col("offset_q"), F.col("_bar") * bar_q)
    tie = F.when(F.col("_first") == F.col("_last"), None).when(F.col("_bar") == F.col("_first"), "start").when(F.col("_bar") == F.col("_last"), "stop").otherwise("continue")
    placed = cut.withColumn("measure_no", (F.col("_bar") + 1).cast("int")).withColumn("offset_in_measure_q", start - F.col("_bar") * bar_q).withColumn("tie", tie)
    return placed.withColumn("length_q", F.least(end, (F.col("_bar") + 1) * bar_q) - start).drop("_bar", "_first", "_last")


# --- ties and durations -------------------------------------------------------------------------


def tie_chains(notes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Notes with the number of their tie chain: a start opens one, continue and stop go on if one is open."""
    line = Window.partitionBy(*by).orderBy(*order)
    tied = F.col("tie").isin("continue", "stop")
    # A chain is open behind any tied note that follows a start without an untied note between.
    open_before = F.last(F.when(F.col("tie") == "start", 1).when(F.col("tie").isNull(), 0), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = notes.withColumn("_open", F.coalesce(open_before, F.lit(0)))
    return chains(marked, by, order, ~(tied & (F.col("_open") == 1)) | F.col("tie").isNull()).drop("_open")


def detied(notes: DataFrame, vocabulary: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Chains of two or more notes whose total length is no word of the vocabulary lose their ties. Lengths are in ticks."""
    chained = tie_chains(notes, by, order)
    group = Window.partitionBy(*by, "chain")
    chained = chained.withColumn("_total", F.sum("ticks").over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    known = vocabulary.select(F.col("ticks").alias("_total")).distinct().withColumn("_known", F.lit(True))
    out = chained.join(F.broadcast(known), "_total", "left")  # a vocabulary of durations
    bad = (F.col("_n") >= 2) & F.col("_known").isNull()
    return out.withColumn("tie", F.when(~bad, F.col("tie"))).drop("_total", "_n", "_known", "chain")


def snapped(notes: DataFrame, vocabulary: list[int]) -> DataFrame:
    """Lengths at the nearest word of the vocabulary, the smaller one of two."""
    words = F.array(*[F.lit(v) for v in sorted(vocabulary)])
    gaps = F.transform(words, lambda v: F.abs(v - F.col("ticks")))
    return notes.withColumn("ticks", F.element_at(words, F.array_position(gaps, F.array_min(gaps)).cast("int")))


# --- patterns and tensors -----------------------------------------------------------------------


def bar_patterns(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, pattern): sixteen slots a bar, O for an onset, H for held, R for rest. A null pitch is a rest.

    Onsets win over held slots in any order, so one aggregation is enough: a bar's onsets and held slots are bits.
    """
    at = music.half_even(F.col("offset_q") * 4)
    length = F.greatest(F.lit(1), music.half_even(F.col("length_q") * 4))
    heard = F.col("pitch").isNotNull() & (at >= 0) & (at < 16)
    power = lambda k: F.pow(F.lit(2.0), k).cast("int")
    onset, held = power(at), power(F.least(at + length, F.lit(16))) - power(at)
    bits = [F.coalesce(F.bit_or(F.when(heard, x)), F.lit(0)).alias(name) for name, x in (("_onset", onset), ("_held", held))]
    has = lambda name, k: F.col(name).bitwiseAND(F.lit(1 << k)) != 0
    pattern = F.concat(*[F.when(has("_onset", k), "O").when(has("_held", k), "H").otherwise("R") for k in range(16)])
    # A bar without a name has no notes, as in a join.
    named = reduce(lambda x, c: x & F.col(c).isNotNull(), by, F.lit(True))
    return events.groupBy(*by).agg(*bits).select(*by, F.when(named, pattern).otherwise(F.lit("R" * 16)).alias("pattern"))


def chord_frames(chords: DataFrame, frames: DataFrame, by: list[str], frames_per_quarter: int, theme_frames: Column) -> DataFrame:
    """(by, frame, pcs): the chord that holds in each frame; frames behind the theme repeat it.

    Chords from the theme's end on are ignored, and frames before the first chord are empty.
    """
    placed = chords.withColumn("_frame", music.half_even(F.col("offset_q") * frames_per_quarter)).where(F.col("_frame") < theme_frames)
    asked = frames.withColumn("_at", F.pmod(F.col("frame"), theme_frames))
    met = asof_join(asked, placed, by, "_at", "_frame", "seq_no", "chord")
    return met.select(*by, "frame", F.coalesce("chord.pcs", F.array().cast("array<int>")).alias("pcs"))


def multi_hot(pcs: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.when(F.array_contains(pcs, k), 1.0).otherwise(0.0).cast("float"))


def tensors(notes: DataFrame, chords: DataFrame, pieces: DataFrame, by: list[str], bars: int, theme_bars: int, frames_per_bar: int, pitch_range: int = 48) -> DataFrame:
    """(by, base_note, rhythm, pitch, chord): the three tensors of each piece as arrays, frame by frame.

    Rhythm and pitch cover the theme's bars; the chord's rows of twelve cover all bars and one frame more, which
    repeats the first of the theme. A piece without notes, or with a chord that has no pitch class, is an error.
    """
    quarter = frames_per_bar // 4
    theme, every = theme_bars * frames_per_bar, bars * frames_per_bar
    frames = lambda n: pieces.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("frame"))
    asked = pieces.select(*by)
    melody = melody_frames(notes, frames(theme), by, quarter, pitch_range)
    in_order = lambda column: F.transform(F.sort_array(F.collect_list(F.struct("frame", column))), lambda x: x[column]).alias(column)
    melody = melody.groupBy(*by).agg(F.first("base_note").alias("base_note"), in_order("rhythm"), in_order("pitch"))
    empty = F.raise_error(F.lit("a chord has no pitch class")).cast("array<int>")
    sound = chords.withColumn("pcs", F.when(F.size("pcs") == 0, empty).otherwise(F.col("pcs")))
    held = chord_frames(sound, frames(every + 1), by, quarter, F.lit(theme)).withColumn("chord", multi_hot(F.col("pcs")))
    held = held.groupBy(*by).agg(in_order("chord"))
    return required_join(asked, melody, by, "no notes in ").join(held, by)


def melody_frames(notes: DataFrame, frames: DataFrame, by: list[str], frames_per_quarter: int, pitch_range: int = 48) -> DataFrame:
    """(by, frame, rhythm, pitch, base_note): tokens of each frame; a later note overwrites an earlier one.

    Pitches count from the octave below the lowest note; ``pitch_range`` stands for held and
    ``pitch_range + 1`` for rest. A pitch beyond the range raises an error.
    """
    base = notes.groupBy(*by).agg((F.floor(F.min("pitch") / 12) * 12).cast("int").alias("base_note"))
    known = notes.join(base, by)
    rel = F.col("pitch") - F.col("base_note")
    at = music.half_even(F.col("offset_q") * frames_per_quarter)
    length = F.greatest(F.lit(1), music.half_even(F.col("length_q") * frames_per_quarter))
    checked = F.when(rel < pitch_range, rel).otherwise(F.raise_error(F.lit("a pitch is beyond the range of the tensor")).cast("int"))
    spread = known.select(*by, "seq_no", checked.alias("_rel"), at.alias("_at"), F.explode(F.sequence(at, at + length - 1)).alias("frame"))
    token = F.struct(F.when(F.col("frame") == F.col("_at"), ONSET).otherwise(HOLD).alias("rhythm"), F.when(F.col("frame") == F.col("_at"), F.col("_rel")).otherwise(pitch_range).alias("pitch"))
    last = spread.groupBy(*by, "frame").agg(F.max_by(token, "seq_no").alias("t"))
    out = frames.join(base, by).join(last, [*by, "frame"], "left")
    return out.select(*by, "frame", F.coalesce("t.rhythm", F.lit(REST)).alias("rhythm"), F.coalesce("t.pitch", F.lit(pitch_range + 1)).alias("pitch"), "base_note")


#: Relative weights of the twelve degrees in a major and a minor key (fixed values).
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def keys(histograms: DataFrame, by: list[str]) -> DataFrame:
    """(by, tonic, mode): the key whose profile correlates best with a pitch-class histogram ``vec``."""
    rows = []
    for mode, profile in (("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)):
        centred = [x - sum(profile) / 12 for x in profile]
        size = sum(x * x for x in centred) ** 0.5
        rows += [(t, mode, [centred[(k - t) % 12] / size for k in range(12)]) for t in range(12)]
    profiles = histograms.sparkSession.createDataFrame(rows, "tonic int, mode string, profile array<double>")
    dot = F.aggregate(F.zip_with("vec", "profile", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = histograms.join(F.broadcast(profiles)).withColumn("fit", dot)  # 24 fixed rows beside each piece
    best = scored.groupBy(*by).agg(F.max_by(F.struct("tonic", "mode"), F.struct("fit", -F.col("tonic"))).alias("k"))
    return best.select(*by, "k.tonic", "k.mode")
