"""Loading with skip policies, checks, trial studies and scores from notes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segno.operators import checks, corpus_features, distances, divergence, domain, loading, state, studies
from segno.shared import shared_folder, written
from segno.sources import sinks
from segno.sources.tables import read_csv

from .bindings import NOTES, PIECE, PIECE_NOTES, notes, piece_notes, table, with_ctes
from .corpora import densities_sql
from .book import query
from .runs import NAMES, STATE, _files, _samples, _themes

TRIALS = [42, 123, 7, 999, 2024]


# --- loading ------------------------------------------------------------------------------------


def _parsed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as wanted pieces, their lines as notes; those of urgent orders could not be parsed."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderpriority") == "1-URGENT", "not a score").alias("error"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("seq_no"), (F.col("l_quantity") + 40).cast("int").alias("pitch"))
    return orders, lines.join(orders, "name")


PARSED = """
notes AS (SELECT l_orderkey AS name, (l_quantity + 40)::INTEGER AS pitch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
held AS (SELECT name, count(*) AS n, list(pitch ORDER BY k) AS pitches FROM notes GROUP BY 1),
status AS (SELECT o_orderkey AS name, CASE WHEN n IS NULL THEN 'missing' WHEN o_orderpriority = '1-URGENT' THEN 'parse_error' WHEN n < 2 THEN 'too_short' ELSE 'ok' END AS status, n, pitches FROM orders LEFT JOIN held ON o_orderkey = name)"""


@query("training_piece_status", with_ctes(PARSED) + " SELECT name, status, CASE WHEN status = 'ok' THEN n END AS n_notes FROM status")
def training_pieces(spark, d):
    return loading.piece_status(*_parsed(spark, d)).select("name", "status", F.when(F.col("status") == "ok", F.size("pitches")).cast("long").alias("n_notes"))


@query("generated_intervals", with_ctes(PARSED) + """,
steps AS (SELECT name, k, pitch - lag(pitch) OVER (PARTITION BY name ORDER BY k) AS step FROM notes),
lists AS (SELECT name, string_agg(step::VARCHAR, ',' ORDER BY k) AS intervals FROM steps WHERE step IS NOT NULL GROUP BY 1)
SELECT s.name, CASE WHEN status = 'ok' THEN intervals ELSE '' END AS intervals FROM status s LEFT JOIN lists l ON s.name = l.name""")
def generated_intervals(spark, d):
    return loading.generated_intervals(*_parsed(spark, d)).select("name", F.array_join(F.col("intervals").cast("array<string>"), ",").alias("intervals"))


def _scores(spark, d) -> tuple[DataFrame, DataFrame]:
    """Pieces of 11 to 19 bars with a pickup; an event is a note in one of them, in the second part."""
    events = table(spark, d, "events")
    bars = events.select(F.col("user_id").alias("piece_id")).distinct().withColumn("measure_no", F.explode(F.sequence(F.lit(0), (F.col("piece_id") % 9 + 11).cast("int"))))
    place = F.when(F.col("measure_no") == 0, 0.0).otherwise((F.col("measure_no") - 1) * 4.0 + 1)
    measures = bars.select("piece_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part_no"), "measure_no", F.when(F.col("measure_no") == 0, 3.0).otherwise(0.0).alias("padding_left"), place.alias("offset_q"))
    notes = events.select(F.col("user_id").alias("piece_id"), F.lit(1).alias("part_no"), (F.col("event_id") % 24).cast("int").alias("measure_no"), "event_id")
    return measures, notes


@query("real_chunk_notes", """
SELECT user_id AS piece_id, (event_id % 24)::INTEGER AS measure_no, event_id, ((event_id % 24 - 1) // 8)::INTEGER AS chunk FROM events
WHERE event_id % 24 BETWEEN 1 AND (11 + user_id % 9) // 8 * 8""")
def real_chunks(spark, d):
    return loading.real_chunks(*_scores(spark, d), 8).select("piece_id", "measure_no", "event_id", "chunk")


@query("full_solo_notes", "SELECT user_id AS piece_id, count(*) AS n FROM events WHERE event_id % 24 BETWEEN 1 AND 11 + user_id % 9 GROUP BY 1")
def full_solos(spark, d):
    return loading.full_solos(*_scores(spark, d)).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"))


@query("valid_candidates", "SELECT c_custkey FROM (SELECT c_custkey, c_acctbal, md5('7-' || c_custkey) AS draw FROM customer ORDER BY draw, c_custkey LIMIT 45) WHERE c_acctbal > 0 ORDER BY draw, c_custkey LIMIT 15")
def valid_candidates(spark, d):
    return loading.valid_candidates(table(spark, d, "customer"), "c_custkey", 15, F.col("c_acctbal") > 0, 7).select("c_custkey")


def _paths(spark, d) -> DataFrame:
    """Paths of two chunks of each sample's files; some names carry no number."""
    rows = _samples(spark, d).withColumn("k", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("x"))))
    return rows.select(F.format_string("/runs/themes/%s/%s/sample_%d/gen_chunk_%s.mid", "theme", "model", "sample_idx", "k").alias("path"))


PATHS = STATE + """,
paths AS (SELECT printf('/runs/themes/%s/%s/sample_%d/gen_chunk_%s.mid', theme, model, sample_idx, unnest(['0', '1', 'x'])) AS path, theme, model, sample_idx FROM samples)"""


@query("generated_file_walk", with_ctes(PATHS) + " SELECT path, p.theme, model, sample_idx, path[-5:-5]::INTEGER AS chunk_idx FROM paths p JOIN themes t USING (theme) WHERE NOT removed AND path NOT LIKE '%chunk_x.mid' AND sample_idx < 1")
def walk(spark, d):
    return loading.generated_files(_paths(spark, d), _themes(spark, d).where("not removed"), 1).select("path", "theme", "model", "sample_idx", "chunk_idx")


@query("listing_first", with_ctes(PATHS) + " SELECT path FROM paths ORDER BY path LIMIT 20")
def listing(spark, d):
    """The first twenty files of a corpus, as a run with a limit takes them."""
    return loading.listing(_paths(spark, d), 20)


@query("backfill_status", with_ctes(STATE) + """
SELECT e.theme, e.model, e.sample_idx, CASE WHEN f.theme IS NOT NULL THEN 'skipped' WHEN chunks = 0 THEN 'missing_theme_chunk' WHEN s.theme IS NULL OR NOT ok THEN 'midi_load_failed' ELSE 'written' END AS status
FROM expected e LEFT JOIN files f USING (theme, model, sample_idx) LEFT JOIN samples s USING (theme, model, sample_idx)""")
def backfill(spark, d):
    themes = _themes(spark, d)
    parsed = _samples(spark, d).withColumn("error", F.when(~F.col("ok"), "unreadable"))
    return loading.backfill_status(state.expected_samples(themes, NAMES, 2), _files(spark, d), themes.where("chunks > 0"), parsed, state.SAMPLE, ["theme"])


# --- checks -------------------------------------------------------------------------------------


@query("task_violations", """
WITH t AS (SELECT o_orderkey AS task_id, ['mirror', 'multiple', 'free'][(o_orderkey % 3)::INTEGER + 1] AS rule, o_custkey % 5 AS given, o_orderkey % 7 AS asked, o_custkey % 4 AS measures, CASE WHEN o_custkey % 11 > 0 THEN 3 + o_custkey % 2 END AS num FROM orders)
SELECT task_id, violation FROM (SELECT task_id, unnest([
  CASE WHEN given <= 0 THEN 'input_bars must be positive' END, CASE WHEN asked <= 0 THEN 'output_bars must be positive' END,
  CASE WHEN measures < given THEN 'fewer measures than input_bars' END, CASE WHEN num = 3 THEN 'meter must be 4/4' END,
  CASE WHEN rule = 'mirror' AND given <> asked THEN 'output_bars must equal input_bars' END, CASE WHEN rule = 'mirror' AND asked <> 4 THEN 'output_bars must be half of num_bars' END,
  CASE WHEN rule = 'multiple' AND given > 0 AND asked % nullif(given, 0) <> 0 THEN 'output_bars must be a multiple of input_bars' END]) AS violation FROM t) WHERE violation IS NOT NULL""")
def task_violations(spark, d):
    rows = table(spark, d, "orders")
    rule = F.element_at(F.array(F.lit("mirror"), F.lit("multiple"), F.lit("free")), (F.col("o_orderkey") % 3).cast("int") + 1)
    tasks = rows.select(
        F.col("o_orderkey").alias("task_id"), rule.alias("rule"), (F.col("o_custkey") % 5).alias("input_bars"), (F.col("o_orderkey") % 7).alias("output_bars"), F.lit(8).alias("num_bars"),
        (F.col("o_custkey") % 4).alias("measures"), F.when(F.col("o_custkey") % 11 > 0, F.col("o_custkey") % 2 + 3).alias("ts_num"), F.lit(4).alias("ts_den"),
    )
    return checks.task_violations(tasks)


@query("chorus_counts", "SELECT DISTINCT (o_custkey % 4 + 1)::INTEGER AS input_bars, (o_orderkey % 17)::INTEGER AS output_bars, ((o_orderkey % 17) // (o_custkey % 4 + 1) + 1)::INTEGER AS choruses FROM orders")
def chorus_counts(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 4 + 1).cast("int").alias("input_bars"), (F.col("o_orderkey") % 17).cast("int").alias("output_bars")).distinct()
    return rows.withColumn("choruses", checks.chorus_count(F.col("input_bars"), F.col("output_bars")))


@query("key_differences", "SELECT coalesce(o, c) AS custkey, CASE WHEN o IS NULL THEN 'missing' ELSE 'unknown' END AS problem FROM (SELECT DISTINCT o_custkey + 10 AS o FROM orders) FULL JOIN (SELECT DISTINCT c_custkey AS c FROM customer) ON o = c WHERE o IS NULL OR c IS NULL")
def key_differences(spark, d):
    found = table(spark, d, "orders").select((F.col("o_custkey") + 10).alias("custkey"))
    return checks.key_differences(found, table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), ["custkey"])


@query("output_collisions", "SELECT path, 'written twice' AS problem FROM (SELECT o_custkey AS path FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT DISTINCT o_custkey, 'exists' FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def collisions(spark, d):
    return checks.collisions(table(spark, d, "orders").select(F.col("o_custkey").alias("path")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("path")))


# --- trials -------------------------------------------------------------------------------------

SELECTED = f"selected AS (SELECT trial, c_custkey FROM (SELECT trial, c_custkey, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '-' || c_custkey), c_custkey) AS k FROM customer, (SELECT unnest({TRIALS}) AS trial)) WHERE k <= 15)"


@query("trial_selections", with_ctes(SELECTED) + " SELECT trial, c_custkey FROM selected")
def selections(spark, d):
    return studies.selections(table(spark, d, "customer"), "c_custkey", 15, TRIALS)


@query("trial_union", with_ctes(SELECTED) + " SELECT c_custkey, count(DISTINCT trial) AS n_trials FROM selected GROUP BY 1")
def union_of_trials(spark, d):
    return studies.selected_once(studies.selections(table(spark, d, "customer"), "c_custkey", 15, TRIALS), "c_custkey")


NOISE = f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
cut AS (SELECT trial AS grp, id, vec, row_number() OVER p <= n // 2 AS a FROM (SELECT *, count(*) OVER (PARTITION BY trial) AS n FROM v, (SELECT unnest({TRIALS}) AS trial)) WINDOW p AS (PARTITION BY trial ORDER BY md5(trial || '-' || id), id)),
dists AS (SELECT x.grp, NULL AS model, 'intra' AS kind, list_distance(x.vec, y.vec) AS dist, 2 AS w FROM cut x JOIN cut y ON x.grp = y.grp AND x.id < y.id WHERE x.a AND y.a
          UNION ALL SELECT x.grp, 'b', 'inter', list_distance(x.vec, y.vec), 1 FROM cut x JOIN cut y ON x.grp = y.grp WHERE x.a AND NOT y.a),{densities_sql(8192)}"""
@query("half_noise_kl_oa", NOISE + " SELECT grp::INTEGER AS trial, round(kl, 5) AS kl, round(oa, 5) AS oa FROM measured")
def half_noise(spark, d):
    """All embeddings as one corpus: half of it against the other, in five trials."""
    vectors = table(spark, d, "embeddings").select(F.lit("embedding").alias("feature"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return studies.half_noise(vectors, ["feature"], TRIALS).select("trial", F.round("kl", 5).alias("kl"), F.round("oa", 5).alias("oa"))


@query("half_noise_summary", NOISE + " SELECT count(*) AS n_trials, " + ", ".join(f"round(avg({v}), 4) AS {v}_mean, round(stddev_pop({v}), 4) AS {v}_std, round(min({v}), 4) AS {v}_min, round(max({v}), 4) AS {v}_max" for v in ("kl", "oa")) + " FROM measured")
def half_noise_summary(spark, d):
    vectors = table(spark, d, "embeddings").select(F.lit("embedding").alias("feature"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    out = studies.summary(studies.half_noise(vectors, ["feature"], TRIALS), ["feature"])
    return out.select("n_trials", *[F.round(c, 4).alias(c) for c in out.columns if c not in ("feature", "n_trials")])


# --- scores from notes --------------------------------------------------------------------------


@query("melody_measures", with_ctes(NOTES, PIECE_NOTES) + """,
q AS (SELECT theme, model, seq_no, pitch, on_ticks, on_ticks + ticks AS end_ticks, unnest(range(on_ticks // 16, (on_ticks + ticks - 1) // 16 + 1)) AS bar FROM piece_notes)
SELECT theme, model, seq_no, pitch, (bar + 1)::INTEGER AS measure_no, (greatest(on_ticks, bar * 16) - bar * 16) / 4.0::DOUBLE AS offset_in_measure_q, (least(end_ticks, bar * 16 + 16) - greatest(on_ticks, bar * 16)) / 4.0::DOUBLE AS length_q,
       CASE WHEN on_ticks // 16 = (end_ticks - 1) // 16 THEN NULL WHEN bar = on_ticks // 16 THEN 'start' WHEN bar = (end_ticks - 1) // 16 THEN 'stop' ELSE 'continue' END AS tie FROM q""")
def melody_measures(spark, d):
    rows = piece_notes(spark, d).withColumn("offset_q", F.col("on_ticks") / 4.0).withColumn("length_q", F.col("ticks") / 4.0)
    return domain.melody_measures(rows).select(*PIECE, "seq_no", "pitch", "measure_no", "offset_in_measure_q", "length_q", "tie")


@query("quarter_snapping", """
WITH o AS (SELECT user_id, event_id, off, floor(off) AS q, off - floor(off) AS f FROM (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT % 3600 / 60.0::DOUBLE AS off FROM events)),
g AS (SELECT user_id, q, CASE WHEN round(sum(abs(f - round_even(f * 3, 0) / 3)), 9) < round(sum(abs(f - round_even(f * 4, 0) / 4)), 9) THEN 3 ELSE 4 END AS grid FROM o GROUP BY ALL)
SELECT event_id, grid, round(q + round_even(f * grid, 0) / grid, 6) AS snapped_q FROM o JOIN g USING (user_id, q)""")
def quarter_snapping(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.unix_timestamp(F.date_trunc("second", "ts")) % 3600 / 60.0).alias("offset_q"))
    return domain.quarter_snapped(rows, ["user_id"]).select("event_id", "grid", F.round("snapped_q", 6).alias("snapped_q"))


# --- a factorial study --------------------------------------------------------------------------

FACTORS, LEVELS = ("slicing", "source"), {"slicing": ("full", "chunked"), "source": ("first", "second")}
STUDIED = ["total_used_pitch", "total_used_note", "pitch_range", "avg_pitch_interval", "avg_ioi"]

UNITS = f"""
ordered AS (SELECT theme, model, sample_idx, chunk_idx, instr, pitch, ticks, row_number() OVER w AS seq_no, coalesce(sum(ticks) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.125::DOUBLE AS start_s
            FROM (SELECT * EXCLUDE (seq_no, start_s, end_s), seq_no AS k FROM notes) WINDOW w AS (PARTITION BY theme, model, sample_idx ORDER BY chunk_idx, k)),
placed AS (SELECT 'full' AS slicing, sample_idx, theme::VARCHAR AS unit, model, pitch, seq_no, start_s, start_s + ticks * 0.125::DOUBLE AS end_s FROM ordered
           UNION ALL SELECT 'chunked', sample_idx, theme || '-' || chunk_idx, model, pitch, seq_no, start_s, end_s FROM notes),
stepped AS (SELECT *, abs(pitch - lag(pitch) OVER (PARTITION BY slicing, sample_idx, unit, model ORDER BY start_s, pitch, seq_no)) AS step, floor(end_s * 100) - floor(start_s * 100) AS frames FROM placed),
scalars AS (SELECT slicing, CASE sample_idx WHEN 0 THEN 'first' ELSE 'second' END AS source, unit, model, count(DISTINCT pitch)::DOUBLE AS total_used_pitch, count(*)::DOUBLE AS total_used_note,
             (max(pitch) FILTER (frames > 0) - min(pitch) FILTER (frames > 0))::DOUBLE AS pitch_range, CASE WHEN count(*) >= 2 THEN avg(step) END AS avg_pitch_interval,
             CASE WHEN count(*) >= 2 THEN (max(start_s) - min(start_s)) / (count(*) - 1) END AS avg_ioi FROM stepped GROUP BY ALL),
vectors AS (SELECT feature || '/' || slicing || '/' || source AS grp, unit, model, x FROM (UNPIVOT scalars ON {", ".join(STUDIED)} INTO NAME feature VALUE x)),
dists AS (SELECT a.grp, NULL AS model, 'intra' AS kind, abs(a.x - b.x) AS dist, 2 AS w FROM vectors a JOIN vectors b ON a.grp = b.grp AND a.unit < b.unit WHERE a.model = 'N' AND b.model = 'N'
          UNION ALL SELECT a.grp, b.model, 'inter', abs(a.x - b.x), 1 FROM vectors a JOIN vectors b ON a.grp = b.grp WHERE a.model = 'N' AND b.model = 'A'),"""
_WIDE = ", ".join(f"max({v}) FILTER (term = '{t}') AS {t}_{v}" for t in ("full", "chunked", "first", "second", *[f"{x}_{y}" for x in LEVELS["slicing"] for y in LEVELS["source"]]) for v in ("kl", "oa"))
CELLS = f"""
cells AS (SELECT split_part(grp, '/', 1) AS feature, split_part(grp, '/', 2) AS slicing, split_part(grp, '/', 3) AS source, kl, oa FROM measured),
terms AS (SELECT feature, CASE WHEN slicing IS NOT NULL AND source IS NOT NULL THEN slicing || '_' || source ELSE coalesce(slicing, source, 'all') END AS term, avg(kl) AS kl, avg(oa) AS oa FROM cells GROUP BY GROUPING SETS ((feature, slicing, source), (feature, slicing), (feature, source), (feature))),
spread AS (SELECT feature, {_WIDE} FROM terms GROUP BY 1)"""


def _effects() -> str:
    rows = {"slicing": "{x}chunked{v} - {x}full{v}", "source": "{x}second{v} - {x}first{v}", "interaction": "({x}chunked_second{v} - {x}full_second{v}) - ({x}chunked_first{v} - {x}full_first{v})"}
    one = lambda form: ", ".join(f"round({form.format(x='', v='_' + v)}, 3) + 0.0::DOUBLE AS {v}" for v in ("kl", "oa"))
    return " UNION ALL ".join(f"SELECT feature, 'effect_{k}' AS term, {one(form)} FROM spread" for k, form in rows.items())


@query("factorial_2x2", f"WITH {NOTES}, {UNITS}{densities_sql(8192)}, {CELLS} SELECT feature, term, round(kl, 3) AS kl, round(oa, 3) AS oa FROM terms UNION ALL {_effects()}")
def factorial(spark, d):
    """KL and overlap of one model by slicing and source, written as the study's wide report and taken from it again.

    Pieces are themes or their chunks, the source is the sample; the real pieces are cut alike.
    """
    rows = notes(spark, d).where("model in ('N', 'A')")
    line = Window.partitionBy("theme", "model", "sample_idx").orderBy("chunk_idx", "seq_no")
    start = F.coalesce(F.sum("ticks").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 0.125
    full = rows.select("model", "sample_idx", "instr", "pitch", F.row_number().over(line).alias("seq_no"), "ticks", start.alias("start_s"), F.lit("full").alias("slicing"), F.col("theme").cast("string").alias("id"))
    full = full.withColumn("end_s", F.col("start_s") + F.col("ticks") * 0.125)
    cut = rows.select("model", "sample_idx", "instr", "pitch", "seq_no", "ticks", "start_s", F.lit("chunked").alias("slicing"), F.concat_ws("-", "theme", "chunk_idx").alias("id"), "end_s")
    source = F.when(F.col("sample_idx") == 0, "first").otherwise("second")
    by = ["slicing", "source", "id", "model"]
    vec = written(corpus_features.scalar_features(full.unionByName(cut).withColumn("source", source), by))
    key = ["feature", *FACTORS]
    samples = distances.distance_samples(vec.where("model = 'N'").drop("model"), vec.where("model = 'A'"), key)
    cells = divergence.kl_and_overlap(samples, key).where(F.col("feature").isin(STUDIED)).select(*key, "kl", "oa")
    values = ["kl", "oa"]
    wide = studies.wide_cells(cells, ["feature"], FACTORS, LEVELS, values)
    path = f"{shared_folder(spark).rstrip('/')}/study-{uuid.uuid4().hex}/result.csv"
    sinks.write_csv(wide, path, ["feature"])
    read = read_csv(spark, path, ", ".join(f"{c} {kind}" for c, kind in wide.dtypes))
    out = studies.factorial(studies.read_cells(read, ["feature"], FACTORS, LEVELS, values), ["feature"], FACTORS, LEVELS, values)
    return out.select("feature", "term", *[(F.round(v, 3) + F.lit(0.0)).alias(v) for v in values])  # no negative zero
