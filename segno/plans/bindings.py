"""The driver's tables read as music, in Spark and as SQL that says the same.

lineitem  a row is a note: theme = supplier, model = return flag, sample and chunk from the order
          number, pitch = 40 + quantity, length = 1 + 100 * discount sixteenths; notes of a segment
          follow each other at 120 beats a minute.
supplier  each theme has eight chunks of eight chords.
events    a row is an event of a user's piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segno.functions import music
from segno.operators.segment_metrics import SEGMENT, pitch_sequences
from segno.sources.tables import read_table

MODELS = ["R", "N", "A"]
REAL, GENERATED = "N", ["A", "R"]
TICK_S = 0.125
KINDS = [*music.CHORD_TONES, "other"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


#: What orders the notes of a segment.
NOTE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "price"]


def _told() -> dict[str, Column]:
    """What an order's and a line's number say of a note. Queries are listed without a session, columns need one."""
    return {
        "sample_idx": (F.col("l_orderkey") % 2).cast("int"),
        "chunk_idx": (F.floor(F.col("l_orderkey") / 2) % 8).cast("int"),
        "velocity": (F.col("l_linenumber") + 60).cast("int"),
    }


def _note_rows(spark: SparkSession, d: str) -> DataFrame:
    told = _told()
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("theme"),
        F.col("l_returnflag").alias("model"),
        told["sample_idx"].alias("sample_idx"),
        told["chunk_idx"].alias("chunk_idx"),
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_quantity") + 40).cast("int").alias("pitch"),
        told["velocity"].alias("velocity"),
        (F.round(F.col("l_discount") * 100) + 1).cast("int").alias("ticks"),
        F.col("l_extendedprice").alias("price"),
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy(*SEGMENT).orderBy(*NOTE_ORDER)
    start = F.coalesce(F.sum("ticks").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _note_rows(spark, d).withColumn("seq_no", F.row_number().over(line)).withColumn("on_ticks", start.cast("long"))
    return rows.select(
        *SEGMENT, F.lit(0).alias("instr"), "seq_no", "pitch", "velocity", "ticks", "on_ticks",
        (F.col("on_ticks") * TICK_S).alias("start_s"), ((F.col("on_ticks") + F.col("ticks")) * TICK_S).alias("end_s"),
    )


NOTES = f"""
notes AS (
  SELECT theme, model, sample_idx, chunk_idx, 0 AS instr, row_number() OVER w AS seq_no, pitch, velocity, ticks,
         coalesce(sum(ticks) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS on_ticks,
         coalesce(sum(ticks) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * {TICK_S}::DOUBLE AS start_s,
         (coalesce(sum(ticks) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ticks)::DOUBLE * {TICK_S}::DOUBLE AS end_s
  FROM (SELECT l_suppkey AS theme, l_returnflag AS model, (l_orderkey % 2)::INTEGER AS sample_idx, ((l_orderkey // 2) % 8)::INTEGER AS chunk_idx,
               l_orderkey, l_linenumber, l_partkey, (l_quantity + 40)::INTEGER AS pitch, (l_linenumber + 60)::INTEGER AS velocity,
               (round(l_discount * 100) + 1)::INTEGER AS ticks, l_extendedprice AS price FROM lineitem)
  WINDOW w AS (PARTITION BY theme, model, sample_idx, chunk_idx ORDER BY l_orderkey, l_linenumber, l_partkey, price)
)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment that could exist, with or without notes."""
    themes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("theme"))
    some = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    return themes.withColumn("model", some(MODELS)).withColumn("sample_idx", some(range(2))).withColumn("chunk_idx", some(range(8)))


SEGMENTS = "segments AS (SELECT s_suppkey AS theme, model, sample_idx, chunk_idx FROM supplier, (SELECT unnest(['R', 'N', 'A']) AS model), (SELECT unnest(range(2))::INTEGER AS sample_idx), (SELECT unnest(range(8))::INTEGER AS chunk_idx))"


def chords(spark: SparkSession, d: str) -> DataFrame:
    """Eight chords a chunk, every second quarter; some have no root, some an unknown kind."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("theme"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("chunk_idx"))
    rows = rows.withColumn("seq_no", F.explode(F.sequence(F.lit(0), F.lit(7))))
    mix = F.col("theme") * 7 + F.col("chunk_idx") * 5 + F.col("seq_no") * 3
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rows = rows.select(
        "theme", "chunk_idx", "seq_no", (F.col("seq_no") * 2.0 + 1).alias("offset_q"),
        F.when(mix % 11 != 10, (mix % 12).cast("int")).alias("root_pc"),
        F.element_at(kinds, (mix % len(KINDS)).cast("int") + 1).alias("kind"),
    )
    return music.with_pitch_classes(rows)


def _kind_rows() -> str:
    rows = []
    for k, kind in enumerate(KINDS):
        tones = music.CHORD_TONES.get(kind, music.CHORD_TONES["major"])
        steps = music.SCALES[music.KIND_SCALE.get(kind, "major")]
        rows.append(f"({k}, '{kind}', {list(tones)}, {list(steps)})")
    return ", ".join(rows)


CHORDS = f"""
kinds AS (SELECT * FROM (VALUES {_kind_rows()}) AS v(k, kind, tones, steps)),
chords AS (
  SELECT theme, chunk_idx, seq_no, (seq_no * 2 + 1)::DOUBLE AS offset_q, root_pc, kind,
         CASE WHEN root_pc IS NULL THEN [] ELSE list_transform(tones, lambda x: (x + root_pc) % 12) END AS pcs,
         CASE WHEN root_pc IS NULL THEN [] ELSE list_transform(steps, lambda x: (x + root_pc) % 12) END AS scale_pcs
  FROM (SELECT theme, chunk_idx, seq_no, CASE WHEN mix % 11 <> 10 THEN (mix % 12)::INTEGER END AS root_pc, mix % {len(KINDS)} AS k
        FROM (SELECT s_suppkey AS theme, chunk_idx, seq_no, s_suppkey * 7 + chunk_idx * 5 + seq_no * 3 AS mix
              FROM supplier, (SELECT unnest(range(8))::INTEGER AS chunk_idx), (SELECT unnest(range(8))::INTEGER AS seq_no))) JOIN kinds USING (k)
)"""


def melodies(spark: SparkSession, d: str) -> DataFrame:
    """A theme's own melody in a chunk: the real model's first sample."""
    own = notes(spark, d).where((F.col("model") == REAL) & (F.col("sample_idx") == 0))
    return pitch_sequences(own, ["theme", "chunk_idx"], ["start_s", "seq_no"]).withColumnRenamed("pitches", "melody")


PIECE = ["theme", "model"]


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """A piece is a theme of a model: its segments' tempo and meter."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("theme"), F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    return rows.select("theme", "model", F.lit(120.0).alias("tempo_bpm"), F.lit(4).alias("ts_num"), F.lit(4).alias("ts_den"))


def piece_notes(spark: SparkSession, d: str, portion: int = 0, portions: int = 1, tasks: int | None = None) -> DataFrame:
    """Notes of a piece: those of all its segments, one after the other. One shuffle and one sort, by piece.

    Of ``portions`` of the themes, those of one; ``tasks`` deals them by theme to so many, so that a theme's chords
    can meet its pieces there.
    """
    held = _note_rows(spark, d)
    if portions > 1:
        held = held.where(F.pmod(F.xxhash64("theme"), F.lit(portions)) == portion)
    if tasks:
        # What the order numbers give is worked out again behind the shuffle, which has less to carry.
        told = _told()
        held = held.drop(*told).repartition(tasks, "theme").withColumns(told)
    line = Window.partitionBy(*PIECE).orderBy("sample_idx", "chunk_idx", *NOTE_ORDER)
    start = F.coalesce(F.sum("ticks").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = held.select(*PIECE, F.lit(0).alias("instr"), F.row_number().over(line).alias("seq_no"), "pitch", "velocity", "ticks", start.alias("on_ticks"))
    return rows.withColumn("start_s", F.col("on_ticks") * TICK_S).withColumn("end_s", (F.col("on_ticks") + F.col("ticks")) * TICK_S)


PIECE_NOTES = f"""
piece_notes AS (
  SELECT *, on_ticks::DOUBLE * {TICK_S}::DOUBLE AS start_s, (on_ticks + ticks)::DOUBLE * {TICK_S}::DOUBLE AS end_s
  FROM (SELECT theme, model, instr, row_number() OVER w AS seq_no, pitch, velocity, ticks, coalesce(sum(ticks) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS on_ticks
        FROM (SELECT * RENAME (seq_no AS k) FROM notes) WINDOW w AS (PARTITION BY theme, model ORDER BY sample_idx, chunk_idx, k))
)"""


def measure_events(spark: SparkSession, d: str) -> DataFrame:
    """A bar is a user's hour: a sixteenth is 225 seconds, errors are rests."""
    rows = table(spark, d, "events")
    second = F.unix_timestamp(F.date_trunc("second", "ts"))
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 3).cast("int") + 1)
    return rows.select(
        model.alias("model"), "user_id", F.floor(second / 3600).alias("bar"),
        ((second % 3600) / 900.0).alias("offset_q"),
        ((F.floor("value") % 8) / 4.0).alias("length_q"),
        F.when(F.col("event_type") != "error", F.floor("value").cast("int")).alias("pitch"),
    )


MEASURES = """
measures AS (
  SELECT ['R', 'N', 'A'][(user_id % 3)::INTEGER + 1] AS model, user_id, (s // 3600)::BIGINT AS bar, (s % 3600) / 900.0::DOUBLE AS offset_q,
         (floor(value)::BIGINT % 8) / 4.0::DOUBLE AS length_q, CASE WHEN event_type <> 'error' THEN floor(value)::INTEGER END AS pitch
  FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
