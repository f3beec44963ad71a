"""Cutting, retiming and spelling of scores."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from segno.functions import music
from segno.operators import assembly, domain, relational
from segno.shared import shared_folder, shuffles_dropped, written
from segno.sources import score_source, sinks
from segno.streaming import streams

from .bindings import CHORDS, NOTES, PIECE, PIECE_NOTES, chords, notes, piece_notes, pieces, table, with_ctes
from .book import query

BASE = with_ctes(NOTES, PIECE_NOTES)

#: Notes that are dealt to pieces and written as scores at a time, notes of a task about, and tasks at least.
PORTION_NOTES, TASK_NOTES, TASKS = 3_000_000, 100_000, 12


@query("chunk_rows_drop_tail", """
SELECT user_id, event_id, (k // 8)::INTEGER AS chunk FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k // 8 < n // 8""")
def chunk_rows(spark, d):
    return relational.chunk_rows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id", "chunk")


@query("bar_chunks", """
SELECT user_id AS piece_id, bar AS measure_no, (k // 8)::INTEGER AS chunk, (k % 8 * 4)::DOUBLE AS offset_in_chunk_q
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bar) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, unnest(range(1, 1 + 11 + user_id % 9)) AS bar FROM (SELECT DISTINCT user_id FROM events))) WHERE k // 8 < n // 8""")
def bar_chunks(spark, d):
    """Measures of pieces of 11 to 19 bars with a pickup: pickups and tails go."""
    users = table(spark, d, "events").select(F.col("user_id").alias("piece_id")).distinct()
    bars = users.withColumn("measure_no", F.explode(F.sequence(F.lit(0).cast("long"), 10 + F.lit(1) + F.col("piece_id") % 9)))
    measures = bars.select("piece_id", F.lit(0).alias("part_no"), "measure_no", F.when(F.col("measure_no") == 0, 3.0).otherwise(0.0).alias("padding_left"), (F.greatest(F.col("measure_no") - 1, F.lit(0)) * 4.0 + F.when(F.col("measure_no") > 0, 1.0).otherwise(0.0)).alias("offset_q"))
    return domain.bar_chunks(measures, 8).select("piece_id", "measure_no", "chunk", "offset_in_chunk_q")


WINDOWS = BASE + """,
ends AS (SELECT theme, model, max(end_s) AS last_s FROM piece_notes GROUP BY ALL),
placed AS (SELECT theme, model, floor(start_s / 4.0::DOUBLE)::INTEGER AS "window", seq_no, pitch, start_s, end_s FROM piece_notes)"""
MOVED = """round(start_s - "window" * 4.0::DOUBLE, 6) AS start_s, round(least(end_s, "window" * 4.0::DOUBLE + 4) - "window" * 4.0::DOUBLE, 6) AS end_s"""


def _moved(got):
    return got.select(*PIECE, "window", "seq_no", "pitch", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("slice_bars", WINDOWS + f"""
SELECT theme, model, "window", seq_no, pitch, {MOVED} FROM placed JOIN ends USING (theme, model) WHERE "window" < floor((last_s + 1e-6::DOUBLE) / 4.0::DOUBLE)""")
def slice_bars(spark, d):
    """Windows of two bars of equal length; empty ones go."""
    return _moved(domain.slice_bars(piece_notes(spark, d), pieces(spark, d), PIECE, 2))


@query("slice_downbeats", WINDOWS + f""",
frames AS (SELECT theme, model, unnest(range(n))::INTEGER AS "window" FROM (SELECT theme, model, floor((ceil(last_s / 2.0::DOUBLE) - 1) / 2)::INTEGER AS n FROM ends) WHERE n > 0)
SELECT theme, model, "window", seq_no, pitch, {MOVED} FROM frames LEFT JOIN placed USING (theme, model, "window")""")
def slice_downbeats(spark, d):
    """Windows of two bars between downbeats; a piece that ends on a downbeat has no bar behind it."""
    return _moved(domain.slice_downbeats(piece_notes(spark, d), pieces(spark, d), PIECE, 2))


@query("extract_second_half", BASE + """,
cuts AS (SELECT theme, model, floor(n / 2) * 2.0::DOUBLE AS cut FROM (SELECT theme, model, ceil(max(end_s) / 2.0::DOUBLE) AS n FROM piece_notes GROUP BY ALL) WHERE n >= 2)
SELECT theme, model, seq_no, pitch, greatest(start_s - cut, 0) AS start_s, end_s - cut AS end_s FROM piece_notes JOIN cuts USING (theme, model) WHERE start_s >= cut - 1e-9::DOUBLE""")
def second_half(spark, d):
    return domain.second_half(piece_notes(spark, d), pieces(spark, d), PIECE).select(*PIECE, "seq_no", "pitch", "start_s", "end_s")


@query("retempo_transpose", BASE + """
SELECT theme, model, seq_no, (pitch + CASE WHEN up > 5 THEN up - 12 ELSE up END)::INTEGER AS pitch, start_s * 120 / 180.0::DOUBLE AS start_s, end_s * 120 / 180.0::DOUBLE AS end_s
FROM (SELECT *, ((CASE WHEN theme % 2 = 1 THEN 9 ELSE 0 END - theme % 12) % 12 + 12) % 12 AS up FROM piece_notes)""")
def retempo_transpose(spark, d):
    """Notes at 180 beats a minute in C major or A minor; a theme's number stands for its key."""
    moved = domain.retempo(piece_notes(spark, d), F.lit(120), F.lit(180.0))
    steps = music.transposition(F.col("theme") % 12, F.when(F.col("theme") % 2 == 1, "minor").otherwise("major"))
    return domain.transposed(moved, steps).select(*PIECE, "seq_no", F.col("pitch").cast("int").alias("pitch"), "start_s", "end_s")


@query("tile_cyclic", with_ctes(CHORDS) + "SELECT theme, chunk_idx, seq_no, offset_q + k * 16 AS offset_q, kind FROM chords, (SELECT unnest(range(3))::DOUBLE AS k) WHERE offset_q + k * 16 < 40")
def tile_cyclic(spark, d):
    return domain.cyclic_chords(chords(spark, d), ["theme", "chunk_idx"], 16.0, 40.0).select("theme", "chunk_idx", "seq_no", "offset_q", "kind")


def _tied(spark, d):
    kinds = F.element_at(F.array(F.lit("start"), F.lit("continue"), F.lit("stop"), F.lit(None)), (F.col("velocity") + F.col("pitch")) % 4 + 1)
    return notes(spark, d).withColumn("tie", kinds)


BY = ["theme", "model", "sample_idx", "chunk_idx"]
TIES = """
tied AS (SELECT *, ['start', 'continue', 'stop', NULL][(velocity + pitch) % 4 + 1] AS tie FROM notes),
opened AS (SELECT *, coalesce(last_value(CASE WHEN tie = 'start' THEN 1 WHEN tie IS NULL THEN 0 END IGNORE NULLS) OVER (PARTITION BY theme, model, sample_idx, chunk_idx ORDER BY seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM tied),
chained AS (SELECT *, sum(CASE WHEN tie IN ('continue', 'stop') AND o = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY theme, model, sample_idx, chunk_idx ORDER BY seq_no) AS chain FROM opened)"""


CHAINS = " SELECT theme, model, sample_idx, chunk_idx, chain::BIGINT AS chain, count(*) AS n, sum(ticks)::BIGINT AS ticks FROM chained GROUP BY ALL"


@query("tie_chain_sessions", with_ctes(NOTES, TIES) + CHAINS)
def tie_chains(spark, d):
    got = domain.tie_chains(_tied(spark, d), BY, ["seq_no"])
    return got.groupBy(*BY, "chain").agg(F.count(F.lit(1)).alias("n"), F.sum("ticks").alias("ticks"))


@query("stream_tie_chains", with_ctes(NOTES, TIES) + CHAINS)
def stream_tie_chains(spark, d):
    """The same chains from a stream: notes arrive in three portions, and chains stay open from one to the next."""
    folder = f"{shared_folder(spark).rstrip('/')}/chains-{uuid.uuid4().hex}"
    tied = written(_tied(spark, d).select(*BY, "seq_no", "tie", "ticks"))
    for low, high in ((1, 5), (6, 9), (10, None)):
        tied.where(F.col("seq_no") >= low).where(F.lit(True) if high is None else F.col("seq_no") <= high).write.parquet(f"{folder}/in/from={low}")
        stream = spark.readStream.schema(tied.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        streams.upsert_chains(stream, BY, "seq_no", f"{folder}/out", f"{folder}/state")
    return streams.latest_chains(spark, f"{folder}/out", BY)


@query("score_round_trip", BASE + " SELECT theme::VARCHAR AS theme, model, (row_number() OVER (PARTITION BY theme, model ORDER BY start_s, pitch) - 1)::INTEGER AS seq_no, pitch, velocity, start_s, end_s, 120.0::DOUBLE AS bpm FROM piece_notes")
def score_round_trip(spark, d):
    """Pieces written as MIDI files by the data source, all or nothing, and read back by it."""
    folder = f"{shared_folder(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    score_source.register(spark)
    made = sinks.encoded_scores(piece_notes(spark, d), PIECE)
    made = made.select(F.concat(F.col("theme").cast("string"), F.lit("/"), F.col("model"), F.lit(".mid")).alias("path"), "content")
    made.write.format("segno_scores").mode("append").save(folder)
    read = spark.read.format("segno_scores").option("kind", "midi").load(folder)
    failed = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error")).cast("string"))
    theme, model = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.mid$", 1)
    return read.select(F.coalesce(failed, theme).alias("theme"), model.alias("model"), "seq_no", "pitch", "velocity", "start_s", "end_s", "bpm")


VOCABULARY = [1, 2, 4, 6, 8, 12, 16]


@query("detie_and_snap", with_ctes(NOTES, TIES) + f""",
totals AS (SELECT *, sum(ticks) OVER c AS total, count(*) OVER c AS n FROM chained WINDOW c AS (PARTITION BY theme, model, sample_idx, chunk_idx, chain))
SELECT theme, model, sample_idx, chunk_idx, seq_no, CASE WHEN n >= 2 AND NOT list_contains({VOCABULARY}, total) THEN NULL ELSE tie END AS tie,
       (list_sort(list_transform({VOCABULARY}, lambda v: [abs(v - ticks), v]))[1][2])::INTEGER AS ticks FROM totals""")
def detie_and_snap(spark, d):
    vocabulary = spark.createDataFrame([(v,) for v in VOCABULARY], "ticks int")
    return domain.snapped(domain.detied(_tied(spark, d), vocabulary, BY, ["seq_no"]), VOCABULARY).select(*BY, "seq_no", "tie", "ticks")


FRAMES = with_ctes(CHORDS) + """,
f AS (SELECT theme, chunk_idx, frame, frame % 64 AS place FROM (SELECT DISTINCT theme, chunk_idx FROM chords), (SELECT unnest(range(129))::INTEGER AS frame)),
c AS (SELECT *, round_even(offset_q * 4, 0)::INTEGER AS frame FROM chords WHERE round_even(offset_q * 4, 0) < 64)
SELECT f.theme, f.chunk_idx, f.frame, array_to_string(list_sort(list_distinct(coalesce(c.pcs, []))), ',') AS pcs FROM f ASOF LEFT JOIN c ON f.theme = c.theme AND f.chunk_idx = c.chunk_idx AND f.place >= c.frame"""


@query("ffill_chord_track", FRAMES)
def chord_track(spark, d):
    held = chords(spark, d)
    frames = held.select("theme", "chunk_idx").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(128))))
    got = domain.chord_frames(held, frames, ["theme", "chunk_idx"], 4, F.lit(64))
    return got.select("theme", "chunk_idx", "frame", F.array_join(F.array_sort(F.array_distinct("pcs")), ",").alias("pcs"))


@query("melody_track", BASE + """,
base AS (SELECT theme, model, floor(min(pitch) / 12.0) * 12 AS base_note FROM piece_notes GROUP BY ALL),
spread AS (SELECT theme, model, seq_no, pitch - base_note AS rel, on_ticks AS onset, unnest(range(on_ticks, on_ticks + ticks)) AS frame FROM piece_notes JOIN base USING (theme, model)),
tokens AS (SELECT theme, model, frame, CASE WHEN frame = onset THEN 2 ELSE 1 END AS rhythm, CASE WHEN frame = onset THEN rel ELSE 60 END AS pitch FROM spread)
SELECT theme, model, frame::INTEGER AS frame, coalesce(rhythm, 0)::INTEGER AS rhythm, coalesce(pitch, 61)::INTEGER AS pitch, base_note::INTEGER AS base_note
FROM (SELECT theme, model, base_note, unnest(range(total)) AS frame FROM base JOIN (SELECT theme, model, max(on_ticks + ticks) AS total FROM piece_notes GROUP BY ALL) USING (theme, model)) LEFT JOIN tokens USING (theme, model, frame)""")
def melody_track(spark, d):
    rows = piece_notes(spark, d).withColumn("offset_q", F.col("on_ticks") / 4).withColumn("length_q", F.col("ticks") / 4)
    total = rows.groupBy(*PIECE).agg(F.max(F.col("on_ticks") + F.col("ticks")).cast("int").alias("total"))
    frames = total.select(*PIECE, F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("frame"))
    return domain.melody_frames(rows, frames, PIECE, 4, 60)


@query("nearest_downbeat", "SELECT event_id, abs(s - round_even(s / 3600.0, 0) * 3600) <= 225 AS near FROM (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)")
def nearest_downbeat(spark, d):
    """Events within a sixteenth of an hour's begin."""
    rows = table(spark, d, "events").withColumn("s", F.unix_timestamp(F.date_trunc("second", "ts")).cast("double"))
    return rows.select("event_id", relational.near_downbeat(F.col("s"), F.lit(3600.0), F.lit(1e12), F.lit(225.0)).alias("near"))


@query("downbeat_grid", "SELECT user_id, unnest(range(0, bars + 1)) * 4 AS downbeat_q FROM (SELECT user_id, count(*) // 16 AS bars FROM events GROUP BY 1)")
def downbeat_grid(spark, d):
    bars = table(spark, d, "events").groupBy("user_id").agg(F.floor(F.count(F.lit(1)) / 16).alias("bars"))
    return bars.select("user_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("bars")), lambda k: k * 4)).alias("downbeat_q"))


@query("middle_downbeat", "SELECT user_id, list(bar ORDER BY bar)[len(list(bar)) // 2 + 1] AS middle FROM (SELECT DISTINCT user_id, (epoch(ts)::BIGINT // 86400)::BIGINT AS bar FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)) GROUP BY 1")
def middle_downbeat(spark, d):
    days = table(spark, d, "events").select("user_id", F.floor(F.unix_timestamp(F.date_trunc("second", "ts")) / 86400).alias("bar")).distinct()
    line = Window.partitionBy("user_id")
    placed = days.withColumn("k", F.row_number().over(line.orderBy("bar"))).withColumn("n", F.count(F.lit(1)).over(line))
    return placed.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("user_id", F.col("bar").alias("middle"))


LINE = BASE + """,
lined AS (SELECT theme, model, seq_no, pitch, on_ticks, ticks, CASE WHEN theme % 2 = 0 THEN 16 ELSE 12 END AS u FROM piece_notes),
cut AS (SELECT *, on_ticks + ticks AS end_ticks, unnest(range(on_ticks // u, (on_ticks + ticks - 1) // u + 1)) AS bar FROM lined),
totals AS (SELECT theme, model, max((on_ticks + ticks + u - 1) // u) AS bars FROM lined GROUP BY ALL)"""


def assembled(spark, d, portion, portions, tasks):
    """(path, content): the scores of one of ``portions`` of the themes; notes and chords are dealt to ``tasks`` by theme, once."""
    unit = F.when(F.col("theme") % 2 == 0, 4).otherwise(3)
    rows = piece_notes(spark, d, portion, portions, tasks).select(*PIECE, "seq_no", "pitch", (F.col("on_ticks") / unit / 2).alias("start_s"), ((F.col("on_ticks") + F.col("ticks")) / unit / 2).alias("end_s"))
    line = assembly.melody_line(rows, PIECE, F.lit(120.0))
    # Dealt like the notes: where shuffles have more partitions than there are tasks, the assembled notes would else be dealt again.
    cycles = chords(spark, d).where("chunk_idx = 0").select("theme", "offset_q", "root_pc", "kind").repartition(tasks, "theme")
    made = sinks.assembled_scores(assembly.with_chords(line, cycles, PIECE, 16.0, of=["theme"]), PIECE)
    return made.select(F.concat(F.col("theme").cast("string"), F.lit("-"), F.col("model"), F.lit(".musicxml")).alias("path"), "content")


@query("score_assembly", with_ctes(NOTES, PIECE_NOTES, CHORDS) + LINE.removeprefix(BASE) + """
SELECT theme::VARCHAR AS theme, model, 'note' AS kind, (bar + 1)::INTEGER AS measure_no, round((greatest(on_ticks, bar * u) - bar * u) * 4.0::DOUBLE / u, 6) AS place, round((least(end_ticks, bar * u + u) - greatest(on_ticks, bar * u)) * 4.0::DOUBLE / u, 6) AS length_q, pitch AS value,
       CASE WHEN on_ticks // u = (end_ticks - 1) // u THEN NULL WHEN bar = on_ticks // u THEN 'start' WHEN bar = (end_ticks - 1) // u THEN 'stop' ELSE 'continue' END AS word FROM cut
UNION ALL SELECT theme::VARCHAR, model, 'chord', (floor((offset_q + k * 16) / 4) + 1)::INTEGER, (offset_q + k * 16) % 4, NULL, root_pc, kind
FROM chords JOIN totals USING (theme) CROSS JOIN (SELECT unnest(range(10000)) AS k) WHERE chunk_idx = 0 AND root_pc IS NOT NULL AND offset_q + k * 16 < bars * 4""")
def score_assembly(spark, d):
    """Pieces from seconds to MusicXML in compressed packs and back: sixteenths or triplets, ties at barlines, the theme's chords repeated.

    The pieces of even themes are in sixteenths, those of odd ones in triplets. They are written in portions, so that
    only the notes of one are in shuffle files; a task's notes fit its memory. Files of their own would take a block of
    disk for each score.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    score_source.register(spark)
    n = table(spark, d, "lineitem").count()
    portions, tasks = max(1, -(-n // PORTION_NOTES)), max(TASKS, -(-min(n, PORTION_NOTES) // TASK_NOTES))
    for k in range(portions):
        with shuffles_dropped(spark):
            assembled(spark, d, k, portions, tasks).write.format("segno_scores").option("packs", "true").mode("append").save(folder)
    read = spark.read.format("segno_scores").option("kind", "musicxml").option("packs", "true").load(folder).where("kind in ('note', 'chord') or error is not null")
    failed = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error")).cast("string"))
    theme, model = (F.regexp_extract("path", r"/(-?\d+)-([^/]*)\.musicxml$", k) for k in (1, 2))
    value = F.when(F.col("kind") == "note", F.col("pitch")).otherwise(F.col("root_pc"))
    word = F.when(F.col("kind") == "note", F.col("tie")).otherwise(F.col("chord_kind"))
    length = F.when(F.col("kind") == "note", F.round("length_q", 6))
    return read.select(F.coalesce(failed, theme).alias("theme"), model.alias("model"), "kind", "measure_no", F.round("offset_in_measure_q", 6).alias("place"), length.alias("length_q"), value.alias("value"), word.alias("word"))
