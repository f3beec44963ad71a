"""Measures, tempo maps, score states and tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from segno.functions import music
from segno.operators import domain, loading, state

from .bindings import CHORDS, NOTES, PIECE, PIECE_NOTES, chords, notes, piece_notes, table, with_ctes
from .book import query
from .runs import NAMES, STATE, _files, _samples, _themes
from .studies import _scores

MEASURES = """
scored AS (SELECT DISTINCT user_id AS piece_id FROM events),
bars AS (SELECT piece_id, part_no, measure_no, CASE WHEN measure_no = 0 THEN 0.0 ELSE (measure_no - 1) * 4.0 + 1 END::DOUBLE AS offset_q
         FROM (SELECT piece_id, unnest([0, 1]) AS part_no, measure_no FROM (SELECT piece_id, unnest(range(0, piece_id % 9 + 12))::INTEGER AS measure_no FROM scored)))"""


@query("melody_bars", with_ctes(MEASURES) + " SELECT piece_id, 1 AS part_no, (piece_id % 9 + 11)::BIGINT AS bars FROM scored")
def melody_bars(spark, d):
    """The part that has the melody, and the numbered bars of the first part, of every piece."""
    measures, held = _scores(spark, d)
    return domain.melody_of(measures, held).join(domain.bar_counts(measures), "piece_id")


@query("theme_slices", with_ctes(MEASURES) + """
SELECT piece_id, part_no, measure_no, greatest((measure_no - 1) // 8, 0)::INTEGER AS chunk FROM bars WHERE measure_no <= (piece_id % 9 + 11) // 8 * 8""")
def theme_slices(spark, d):
    """Chunks of eight bars of a theme, whose pickup stays with the first."""
    return domain.theme_chunks(_scores(spark, d)[0], 8).select("piece_id", "part_no", "measure_no", "chunk")


@query("first_bars", with_ctes(MEASURES) + " SELECT piece_id, part_no, measure_no FROM bars WHERE part_no = 0 AND (measure_no BETWEEN 1 AND 14 OR piece_id % 9 + 12 <= 14)")
def first_bars(spark, d):
    """Themes of more than fourteen measures cut to bars 1 to 14; shorter ones keep their pickup."""
    return domain.trimmed(_scores(spark, d)[0].where("part_no = 0"), 14).select("piece_id", "part_no", "measure_no")


@query("generated_measure_status", """
WITH pieces AS (SELECT c_custkey AS piece_id FROM customer), melody AS (SELECT l_orderkey % 1500 AS piece_id, min(l_linenumber) AS part_no FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
bars AS (SELECT o_custkey AS piece_id, count(*) AS n FROM orders JOIN melody ON o_custkey = piece_id AND o_orderkey % 3 + 1 = part_no GROUP BY 1)
SELECT piece_id, CASE WHEN part_no IS NULL THEN 'no_melody' WHEN n IS NULL THEN 'no_measures' ELSE 'ok' END AS status, n AS measures FROM pieces LEFT JOIN melody USING (piece_id) LEFT JOIN bars USING (piece_id)""")
def generated_measure_status(spark, d):
    """Customers as pieces, their orders as measures of one part, long lines as notes: which are skipped, and why."""
    pieces = table(spark, d, "customer").select(F.col("c_custkey").alias("piece_id"))
    bars = table(spark, d, "orders").select(F.col("o_custkey").alias("piece_id"), (F.col("o_orderkey") % 3 + 1).alias("part_no"), F.col("o_orderkey").alias("measure_no"))
    held = table(spark, d, "lineitem").where("l_quantity > 30").select((F.col("l_orderkey") % 1500).alias("piece_id"), F.col("l_linenumber").alias("part_no"))
    status, measures = domain.generated_measures(pieces, bars, held)
    return status.join(measures.groupBy("piece_id").agg(F.count(F.lit(1)).alias("measures")), "piece_id", "left")


TEMPI = "tempi AS (SELECT theme, model, place AS offset_q, bpm FROM (SELECT DISTINCT theme, model FROM piece_notes) CROSS JOIN (VALUES (1.0::DOUBLE, 120.0::DOUBLE), (40.0, 60.0), (90.5, 200.0)) v(place, bpm) WHERE theme % 4 <> 0)"


@query("tempo_map_seconds", with_ctes(NOTES, PIECE_NOTES, TEMPI) + """,
mapped AS (SELECT theme, model, CASE WHEN offset_q = 1 THEN 0 ELSE offset_q END AS at_q, bpm, CASE offset_q WHEN 1 THEN 0.0::DOUBLE WHEN 40 THEN 20.0::DOUBLE ELSE 70.5::DOUBLE END AS at_s FROM tempi),
q AS (SELECT theme, model, seq_no, on_ticks / 4.0::DOUBLE AS a, (on_ticks + ticks) / 4.0::DOUBLE AS b FROM piece_notes),
s AS (SELECT q.*, coalesce(m.at_s, 0) + (a - coalesce(m.at_q, 0)) * 60 / coalesce(m.bpm, 180) AS start_s FROM q ASOF LEFT JOIN mapped m ON q.theme = m.theme AND q.model = m.model AND q.a >= m.at_q)
SELECT s.theme, s.model, seq_no, round(start_s, 9) AS start_s, round(coalesce(m.at_s, 0) + (b - coalesce(m.at_q, 0)) * 60 / coalesce(m.bpm, 180), 9) AS end_s FROM s ASOF LEFT JOIN mapped m ON s.theme = m.theme AND s.model = m.model AND s.b >= m.at_q""")
def tempo_map_seconds(spark, d):
    """Pieces under three tempi, in seconds; every fourth theme states none and goes at 180."""
    rows = piece_notes(spark, d).select(*PIECE, "seq_no", (F.col("on_ticks") / 4.0).alias("offset_q"), (F.col("ticks") / 4.0).alias("length_q"))
    change = F.explode(F.array(*[F.struct(F.lit(at).alias("offset_q"), F.lit(bpm).alias("bpm")) for at, bpm in ((1.0, 120.0), (40.0, 60.0), (90.5, 200.0))])).alias("x")
    tempos = rows.select(*PIECE).distinct().where("theme % 4 <> 0").select(*PIECE, change).select(*PIECE, "x.*")
    return domain.with_tempi(rows, tempos, PIECE).select(*PIECE, "seq_no", F.round("start_s", 9).alias("start_s"), F.round("end_s", 9).alias("end_s"))


@query("score_seconds", with_ctes(NOTES, PIECE_NOTES) + " SELECT theme, model, seq_no, on_ticks / 4.0::DOUBLE * 60 / 90 AS start_s, (on_ticks / 4.0::DOUBLE + ticks / 4.0::DOUBLE) * 60 / 90 AS end_s FROM piece_notes")
def score_seconds(spark, d):
    """Score places at 90 beats a minute as seconds."""
    rows = piece_notes(spark, d).select(*PIECE, "seq_no", (F.col("on_ticks") / 4.0).alias("offset_q"), (F.col("ticks") / 4.0).alias("length_q"))
    return domain.to_seconds(rows, F.lit(90.0)).select(*PIECE, "seq_no", "start_s", "end_s")


def _profile(values: tuple[float, ...], mode: str) -> str:
    centred = [x - sum(values) / 12 for x in values]
    size = sum(x * x for x in centred) ** 0.5
    return ", ".join(f"({t}, '{mode}', [{', '.join(repr(centred[(k - t) % 12] / size) + '::DOUBLE' for k in range(12))}])" for t in range(12))


KEYS = f"""
weights AS (SELECT theme, model, pitch % 12 AS cell, sum(velocity * greatest(floor(end_s * 100) - floor(start_s * 100), 0)) AS n FROM piece_notes WHERE instr = 0 GROUP BY ALL),
vecs AS (SELECT theme, model, list_transform(range(12), lambda c: coalesce(held[c], 0) / total) AS vec FROM (SELECT theme, model, sum(n) AS total, map_from_entries(list((cell, n))) AS held FROM weights GROUP BY ALL) WHERE total > 0),
profiles AS (SELECT * FROM (VALUES {_profile(domain.MAJOR_PROFILE, "major")}, {_profile(domain.MINOR_PROFILE, "minor")}) v(tonic, mode, profile)),
keyed AS (SELECT theme, model, tonic, mode FROM (SELECT *, row_number() OVER (PARTITION BY theme, model ORDER BY list_dot_product(vec, profile) DESC, tonic) AS k FROM vecs, profiles) WHERE k = 1)"""


@query("key_detection", with_ctes(NOTES, PIECE_NOTES, KEYS) + " SELECT theme, model, tonic, mode FROM keyed")
def key_detection(spark, d):
    """The likeliest key of every piece from its pitch classes."""
    from segno.operators.corpus_features import pitch_class_histogram

    return domain.keys(pitch_class_histogram(piece_notes(spark, d), PIECE), PIECE)


@query("score_state", with_ctes(NOTES, PIECE_NOTES, KEYS) + """
SELECT theme, model, CASE WHEN theme % 3 = 0 THEN 180.0 ELSE 100.0 + theme END::DOUBLE AS bpm, tonic + CASE WHEN mode = 'minor' THEN 12 ELSE 0 END AS key_number, 4 AS ts_num, 4 AS ts_den, 0 AS program, 'Piano' AS instrument FROM keyed""")
def score_state(spark, d):
    """What every written piece carries: its theme's tempo or 180, its key's number, 4/4 and the piano."""
    rows = piece_notes(spark, d)
    known = rows.select(*PIECE).distinct().withColumn("bpm", F.when(F.col("theme") % 3 != 0, F.lit(100.0) + F.col("theme")))
    return domain.score_state(rows, known, PIECE)


@query("healed_themes", with_ctes(STATE) + " SELECT theme, theme::BIGINT % 6 = 1 AS removed, chunks FROM themes")
def healed_themes(spark, d):
    """Themes after repair: those that the corpus lost are removed, those that it has again are not."""
    themes = _themes(spark, d)
    return state.self_heal(themes, state.expected_samples(themes, NAMES, 2), _samples(spark, d), _files(spark, d), themes.where("theme % 6 <> 1"))[1]


@query("piece_tensors", with_ctes(NOTES, CHORDS) + """,
melody AS (SELECT theme, chunk_idx, seq_no, pitch, on_ticks // 2 AS onset, greatest(1, ticks // 2) AS n FROM notes WHERE model = 'N' AND sample_idx = 0),
base AS (SELECT theme, chunk_idx, floor(min(pitch) / 12.0) * 12 AS base_note FROM melody GROUP BY ALL),
cells AS (SELECT theme, chunk_idx, seq_no, pitch - base_note AS rel, onset, unnest(range(onset, onset + n)) AS frame FROM melody JOIN base USING (theme, chunk_idx)),
tokens AS (SELECT theme, chunk_idx, frame, max_by(CASE WHEN frame = onset THEN 2 ELSE 1 END, seq_no) AS rhythm, max_by(CASE WHEN frame = onset THEN rel ELSE 60 END, seq_no) AS pitch FROM cells GROUP BY ALL),
grid AS (SELECT theme, chunk_idx, base_note, unnest(range(16))::BIGINT AS frame FROM base),
drawn AS (SELECT theme, chunk_idx, any_value(base_note) AS base_note, string_agg(coalesce(rhythm, 0)::INTEGER::VARCHAR, ',' ORDER BY frame) AS rhythm, string_agg(coalesce(pitch, 61)::INTEGER::VARCHAR, ',' ORDER BY frame) AS pitch
          FROM grid LEFT JOIN tokens USING (theme, chunk_idx, frame) GROUP BY ALL),
held AS (SELECT b.theme, b.chunk_idx, frame, CASE WHEN len(pcs) = 0 THEN [0] ELSE pcs END AS pcs
         FROM (SELECT theme, chunk_idx, unnest(range(33))::BIGINT AS frame FROM base) b ASOF LEFT JOIN (SELECT theme, chunk_idx, offset_q, pcs FROM chords WHERE offset_q < 8) c ON b.theme = c.theme AND b.chunk_idx = c.chunk_idx AND (b.frame % 16) / 2.0::DOUBLE >= c.offset_q),
tensor AS (SELECT theme, chunk_idx, string_agg(array_to_string(list_transform(range(12), lambda k: CASE WHEN pcs IS NOT NULL AND list_contains(pcs, k) THEN '1' ELSE '0' END), ''), ',' ORDER BY frame) AS chord FROM held GROUP BY ALL)
SELECT theme, chunk_idx, base_note::INTEGER AS base_note, rhythm, pitch, chord FROM drawn JOIN tensor USING (theme, chunk_idx)""")
def piece_tensors(spark, d):
    """Rhythm, pitch and chord tensors of every theme's chunk: two bars of eight frames, chords for two times that."""
    by = ["theme", "chunk_idx"]
    rows = notes(spark, d).where("model = 'N' and sample_idx = 0").select(*by, "seq_no", "pitch", (F.floor(F.col("on_ticks") / 2) / 2).alias("offset_q"), (F.floor(F.col("ticks") / 2) / 2).alias("length_q"))
    held = chords(spark, d).withColumn("pcs", F.when(F.size("pcs") == 0, F.array(F.lit(0))).otherwise(F.col("pcs")))
    got = domain.tensors(rows, held, rows.select(*by).distinct(), by, 4, 2, 8, 60)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")
    rows_of = F.array_join(F.transform("chord", lambda x: F.array_join(F.transform(x, lambda y: y.cast("int").cast("string")), "")), ",")
    return got.select(*by, "base_note", text("rhythm").alias("rhythm"), text("pitch").alias("pitch"), rows_of.alias("chord"))


WHOLE = STATE + """,
paths AS (SELECT printf('/runs/themes/%s/%s/sample_%d/%s', theme, model, sample_idx, unnest(['gen_full.mid', 'gen_chunk_0.mid', 'raw_full.mid'])) AS path, theme, model, sample_idx FROM samples)"""


@query("whole_generated_files", with_ctes(WHOLE) + " SELECT path, p.theme, model, sample_idx FROM paths p JOIN themes USING (theme) WHERE NOT removed AND path LIKE '%/gen_full.mid' AND sample_idx < 1")
def whole_generated_files(spark, d):
    """The files of whole generated pieces, which the walk over chunks leaves out."""
    name = F.explode(F.array(*[F.lit(x) for x in ("gen_full.mid", "gen_chunk_0.mid", "raw_full.mid")])).alias("k")
    paths = _samples(spark, d).select("theme", "model", "sample_idx", name).select(F.format_string("/runs/themes/%s/%s/sample_%d/%s", "theme", "model", "sample_idx", "k").alias("path"))
    return loading.whole_files(paths, _themes(spark, d).where("not removed"), 1).select("path", "theme", "model", "sample_idx")


@query("key_numbers", "SELECT c_custkey, (c_custkey % 12 + CASE WHEN c_nationkey % 2 = 0 THEN 12 ELSE 0 END)::BIGINT AS key_number FROM customer")
def key_numbers(spark, d):
    mode = F.when(F.col("c_nationkey") % 2 == 0, "minor").otherwise("major")
    return table(spark, d, "customer").select("c_custkey", music.key_number(F.col("c_custkey") % 12, mode).cast("long").alias("key_number"))
