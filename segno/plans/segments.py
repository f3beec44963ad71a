"""Segment metrics, their aggregates and the final tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.functions import music
from segno.operators import copying, divergence, domain, metrics, phase, relational, summary
from segno.operators import segment_metrics as seg
from segno.shared import shared_folder, written

from .bindings import CHORDS, GENERATED, MEASURES, MODELS, NOTES, REAL, SEGMENTS, chords, measure_events, melodies, notes, segments, with_ctes
from .book import query

KEY = "theme, model, sample_idx, chunk_idx"

MATCHED = f"""
matched AS (
  SELECT n.*, c.pcs, c.scale_pcs, c.offset_q IS NOT NULL AS there, n.pitch % 12 AS pc, max(n.end_s) OVER (PARTITION BY n.theme, n.model, n.sample_idx, n.chunk_idx) AS last_s
  FROM (SELECT *, start_s * 120.0::DOUBLE / 60 AS at_q FROM notes) n ASOF LEFT JOIN chords c ON n.theme = c.theme AND n.chunk_idx = c.chunk_idx AND n.at_q >= c.offset_q
),
flags AS (
  SELECT *, list_contains(pcs, pc) AS tone, list_contains(scale_pcs, pc) AS step, there AND len(scale_pcs) > 0 AS rooted, greatest(end_s - start_s, 0) AS dur,
         abs(start_s - least(round_even(start_s / 2.0::DOUBLE, 0), floor(last_s / 2.0::DOUBLE)) * 2.0::DOUBLE) <= 0.03125::DOUBLE AS first_beat FROM matched
),
chord_metrics AS (
  SELECT {KEY}, count(*) FILTER (there AND tone)::DOUBLE / nullif(count(*) FILTER (there), 0) AS ctr,
         count(*) FILTER (there AND tone AND first_beat)::DOUBLE / nullif(count(*) FILTER (there AND first_beat), 0) AS ctr_first_beat,
         sum(CASE WHEN there AND tone THEN dur ELSE 0 END) / nullif(sum(CASE WHEN there THEN dur ELSE 0 END), 0) AS chord_match_per_time,
         count(*) FILTER (rooted AND step)::DOUBLE / nullif(count(*) FILTER (rooted), 0) AS scale_match,
         sum(CASE WHEN rooted AND step THEN dur ELSE 0 END) / nullif(sum(CASE WHEN rooted THEN dur ELSE 0 END), 0) AS scale_match_per_time
  FROM flags GROUP BY ALL
)"""

ENTROPY = f"""
entropy AS (
  SELECT {KEY}, greatest(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 0) AS pitch_entropy
  FROM (SELECT {KEY}, pitch % 12 AS pc, count(*) AS n FROM notes GROUP BY ALL) GROUP BY ALL
)"""


def _grams(n: int) -> str:
    return f"CASE WHEN len(iv) >= {n} THEN list_distinct(list_transform(range(1, len(iv) - {n - 2}), lambda k: iv[k:k + {n - 1}])) ELSE [] END"


OVERLAP = f"""
iv AS (
  SELECT {KEY}, CASE WHEN len(p) >= 2 THEN list_transform(range(1, len(p)), lambda k: p[k + 1] - p[k]) ELSE [] END AS iv
  FROM (SELECT {KEY}, list(pitch ORDER BY start_s, seq_no) AS p FROM notes GROUP BY ALL)
),
grams AS (SELECT {KEY}, {", ".join(f"{_grams(n)} AS g{n}" for n in (3, 4, 5))} FROM iv),
overlap AS (
  SELECT s.theme, s.model, s.sample_idx, s.chunk_idx, {", ".join(f"CASE WHEN t.theme IS NULL OR len(s.g{n}) = 0 THEN NULL WHEN len(t.g{n}) = 0 THEN 0 ELSE len(list_intersect(s.g{n}, t.g{n}))::DOUBLE / len(s.g{n}) END AS ngram_{n}_overlap" for n in (3, 4, 5))}
  FROM grams s LEFT JOIN (SELECT * FROM grams WHERE model = '{REAL}' AND sample_idx = 0) t ON s.theme = t.theme AND s.chunk_idx = t.chunk_idx
)"""

PER_SEGMENT = f"""
per_segment AS (
  SELECT {KEY}, coalesce(n, 0)::BIGINT AS n_notes, {", ".join(f"round({m}, 6) AS {m}" for m in seg.METRICS if m != "note_density")}, round(coalesce(n, 0) / 8.0::DOUBLE, 6) AS note_density
  FROM segments LEFT JOIN (SELECT {KEY}, count(*) AS n FROM notes GROUP BY ALL) USING ({KEY}) LEFT JOIN chord_metrics USING ({KEY}) LEFT JOIN entropy USING ({KEY}) LEFT JOIN overlap USING ({KEY})
)"""

ALL = with_ctes(NOTES, SEGMENTS, CHORDS, MATCHED, ENTROPY, OVERLAP, PER_SEGMENT)


@query("chord_metrics", with_ctes(NOTES, CHORDS, MATCHED) + f" SELECT {KEY}, round(ctr, 6) AS ctr, round(ctr_first_beat, 6) AS ctr_first_beat, round(chord_match_per_time, 6) AS chord_match_per_time, round(scale_match, 6) AS scale_match, round(scale_match_per_time, 6) AS scale_match_per_time FROM chord_metrics")
def chord_metrics(spark, d):
    out = seg.chord_metrics(notes(spark, d), chords(spark, d))
    return out.select(*seg.SEGMENT, *[F.round(c, 6).alias(c) for c in out.columns if c not in seg.SEGMENT])


@query("asof_chords", with_ctes(NOTES, CHORDS) + "SELECT n.theme, model, sample_idx, n.chunk_idx, n.seq_no, c.kind, c.root_pc FROM (SELECT *, start_s * 2.0::DOUBLE AS at_q FROM notes) n ASOF LEFT JOIN chords c ON n.theme = c.theme AND n.chunk_idx = c.chunk_idx AND n.at_q >= c.offset_q")
def asof_chords(spark, d):
    placed = notes(spark, d).withColumn("at_q", music.seconds_to_quarters(F.col("start_s")))
    met = relational.asof_join(placed, chords(spark, d), ["theme", "chunk_idx"], "at_q", "offset_q", "seq_no")
    return met.select("theme", "model", "sample_idx", "chunk_idx", "seq_no", F.col("match.kind").alias("kind"), F.col("match.root_pc").alias("root_pc"))


@query("note_density_left", with_ctes(NOTES, SEGMENTS) + f" SELECT {KEY}, coalesce(n, 0)::BIGINT AS n_notes, coalesce(n, 0) / 8.0::DOUBLE AS note_density FROM segments LEFT JOIN (SELECT {KEY}, count(*) AS n FROM notes GROUP BY ALL) USING ({KEY})")
def note_density(spark, d):
    return seg.note_density(segments(spark, d), notes(spark, d))


@query("pitch_entropy", with_ctes(NOTES, ENTROPY) + f" SELECT {KEY}, round(pitch_entropy, 6) AS pitch_entropy FROM entropy")
def pitch_entropy(spark, d):
    return seg.pitch_entropy(notes(spark, d)).withColumn("pitch_entropy", F.round("pitch_entropy", 6))


@query("theme_ngram_overlap", with_ctes(NOTES, OVERLAP) + f" SELECT {KEY}, round(ngram_3_overlap, 6) AS ngram_3_overlap, round(ngram_4_overlap, 6) AS ngram_4_overlap, round(ngram_5_overlap, 6) AS ngram_5_overlap FROM overlap")
def theme_overlap(spark, d):
    out = seg.theme_overlap(notes(spark, d), melodies(spark, d))
    return out.select(*seg.SEGMENT, *[F.round(f"ngram_{n}_overlap", 6).alias(f"ngram_{n}_overlap") for n in (3, 4, 5)])


def _per_segment(spark, d, names: list[str] | None = None) -> DataFrame:
    return metrics.per_segment(segments(spark, d), notes(spark, d), chords(spark, d), melodies(spark, d), names=names)


@query("per_segment", ALL + " SELECT * FROM per_segment")
def per_segment(spark, d):
    return _per_segment(spark, d)


#: Metrics that are plugged in beside the standard ones.
PLUGGED = {"mean_pitch": ("pitch_mean", lambda n: F.avg(n.pitch)), "longest_s": ("length_most", lambda n: F.max(n.length))}
for _name, (_part, _make) in PLUGGED.items():
    metrics.add_part(_part, _make)
    metrics.add(metrics.Metric(_name, (_part,), lambda p, part=_part: p[part]))


@query("plugged_metrics", with_ctes(NOTES, SEGMENTS) + f""" SELECT {KEY}, coalesce(n, 0)::BIGINT AS n_notes, round(coalesce(n, 0) / 8.0::DOUBLE, 6) AS note_density, round(mean_pitch, 6) AS mean_pitch, round(longest_s, 6) AS longest_s
FROM segments LEFT JOIN (SELECT {KEY}, count(*) AS n, avg(pitch) AS mean_pitch, max(greatest(end_s - start_s, 0)) AS longest_s FROM notes GROUP BY ALL) USING ({KEY})""")
def plugged_metrics(spark, d):
    """Two metrics that the library does not have, beside one that it has, in one aggregation."""
    return _per_segment(spark, d, ["note_density", *PLUGGED])


LONG = "means AS (UNPIVOT (SELECT model, theme, " + ", ".join(f"avg({m}) AS {m}" for m in seg.METRICS) + " FROM per_segment GROUP BY ALL) ON " + ", ".join(seg.METRICS) + " INTO NAME metric VALUE value)"


@query("theme_means", ALL + ", " + LONG + " SELECT model, theme, metric, round(value, 12) AS value FROM means")
def theme_means(spark, d):
    return seg.theme_means(_per_segment(spark, d)).where("value is not null").withColumn("value", F.round("value", 12))


EIGHT = "n, " + ", ".join(f"round({c}, 12) AS {c}" for c in ("mean", "std", "median", "p25", "p75", "min", "max"))
NUMBERS = "count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, min(value) AS min, max(value) AS max"


@query("aggregates_8stat", ALL + ", " + LONG + f" SELECT model, metric, {EIGHT.replace('n,', 'n AS n_themes,', 1)} FROM (SELECT model, metric, {NUMBERS} FROM means GROUP BY ALL)")
def aggregates(spark, d):
    out = seg.aggregates(_per_segment(spark, d))
    return out.select("model", "metric", "n_themes", *[F.round(c, 12).alias(c) for c in ("mean", "std", "median", "p25", "p75", "min", "max")])


RANKS = ALL + ", " + LONG + """,
pairs AS (SELECT * FROM (VALUES ('R', 'N'), ('R', 'A'), ('N', 'A')) v(model_a, model_b)),
held AS (SELECT metric, model_a, model_b, model = model_a AS own, value FROM means JOIN pairs ON model = model_a OR model = model_b),
ranked AS (SELECT *, rank() OVER (PARTITION BY metric, model_a, model_b ORDER BY value) + (count(*) OVER (PARTITION BY metric, model_a, model_b, value) - 1) / 2.0::DOUBLE AS r FROM held)
SELECT metric, model_a, model_b, count(*) FILTER (own) AS n_a, count(*) FILTER (NOT own) AS n_b,
       round(sum(CASE WHEN own THEN r ELSE 0 END) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0::DOUBLE, 6) AS u_statistic FROM ranked GROUP BY ALL"""


@query("mannwhitney_u", RANKS)
def mann_whitney_u(spark, d):
    got = divergence.rank_sums(seg.theme_means(_per_segment(spark, d)), ["metric"], MODELS)
    return got.select("metric", "model_a", "model_b", "n_a", "n_b", F.round("u_statistic", 6).alias("u_statistic"))


#: Twice the normal tail by Simpson's rule, as SQL has no error function; samples are beyond the exact test's eight.
SIGNIFICANCE = RANKS[: RANKS.index("SELECT metric, model_a, model_b, count(*) FILTER (own) AS n_a")].rstrip() + f""",
sums AS (SELECT metric, model_a, model_b, count(*) FILTER (own) AS n_a, count(*) FILTER (NOT own) AS n_b, sum(CASE WHEN own THEN r ELSE 0 END) AS r FROM ranked GROUP BY ALL),
ties AS (SELECT metric, model_a, model_b, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT metric, model_a, model_b, value, count(*) AS t FROM held GROUP BY ALL) GROUP BY ALL),
tested AS (SELECT *, r - n_a * (n_a + 1) / 2.0::DOUBLE AS u, n_a * n_b / 12.0::DOUBLE * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1))) AS variance FROM sums JOIN ties USING (metric, model_a, model_b)),
scored AS (SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0::DOUBLE - 0.5) / sqrt(variance) AS z FROM tested),
valued AS (SELECT *, CASE WHEN variance <= 0 THEN 1 ELSE least(1, 2 * 0.001 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 12001), lambda k: CASE WHEN k IN (0, 12000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z + 0.003 * k) * (z + 0.003 * k))))) END AS p FROM scored),
asked AS (SELECT metric, model_a, model_b FROM (VALUES {", ".join(f"('{m}')" for m in seg.METRICS)}) v(metric), pairs)
SELECT metric, model_a, model_b, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, CASE WHEN least(n_a, n_b) >= 5 THEN round(u, 6) END AS u_statistic, CASE WHEN least(n_a, n_b) >= 5 THEN round(p, 9) END AS p_value, coalesce(least(n_a, n_b) >= 5 AND p < 0.05, false) AS significant
FROM asked LEFT JOIN valued USING (metric, model_a, model_b)"""


@query("significance", SIGNIFICANCE)
def significance(spark, d):
    got = divergence.mann_whitney(seg.theme_means(_per_segment(spark, d)), ["metric"], MODELS)
    return got.withColumn("u_statistic", F.round("u_statistic", 6)).withColumn("p_value", F.round("p_value", 9))


# --- copying and rhythm -------------------------------------------------------------------------


def _sequences(spark, d) -> DataFrame:
    held = seg.pitch_sequences(notes(spark, d), seg.SEGMENT, ["start_s", "pitch", "seq_no"])
    return held.select(*seg.SEGMENT, music.intervals(F.col("pitches")).alias("seq"))


SEQUENCES = f"""
seqs AS (
  SELECT {KEY}, CASE WHEN len(p) >= 2 THEN list_transform(range(1, len(p)), lambda k: p[k + 1] - p[k]) ELSE [] END AS seq
  FROM (SELECT {KEY}, list(pitch ORDER BY start_s, pitch, seq_no) AS p FROM notes GROUP BY ALL)
)"""


def _pools(spark, d, n: int, models: list[str]) -> DataFrame:
    rows = _sequences(spark, d)
    return copying.pooled_overlap(rows.where(F.col("model") == REAL), rows.where(F.col("model").isin(models)), n)


def _pool_sql(n: int) -> str:
    grams = f"SELECT model, seq[k:k + {n - 1}] AS gram FROM (SELECT model, seq, unnest(range(1, greatest(1, len(seq) - {n - 2}))) AS k FROM seqs)"
    return f"""{with_ctes(NOTES, SEQUENCES)}, grams AS ({grams}), train AS (SELECT DISTINCT gram FROM grams WHERE model = '{REAL}')
SELECT model, count(*) AS n_grams, count(train.gram) AS n_copied, round(count(train.gram)::DOUBLE / count(*), 6) AS overlap FROM grams LEFT JOIN train USING (gram) WHERE model <> '{REAL}' GROUP BY 1"""


def _register_pools() -> None:
    for n in (3, 4, 5):

        @query(f"plagiarism_multiset_{n}", _pool_sql(n))
        def pool(spark, d, n=n):
            return _pools(spark, d, n, GENERATED).withColumn("overlap", F.round("overlap", 6))


_register_pools()


def _corpora(spark, d, models: list[str] = GENERATED) -> tuple[DataFrame, DataFrame]:
    """Training pieces are all real segments, chunks all generated ones, named by their place."""
    name = F.concat_ws("-", "theme", "sample_idx", "chunk_idx")
    rows = _sequences(spark, d)
    train = rows.where(F.col("model") == REAL).select(name.alias("piece"), "seq")
    return rows.where(F.col("model").isin(models)).select("model", name.alias("chunk"), "seq"), train


def lcs_sql(models: list[str]) -> str:
    """CTEs that end in ``s``, the pieces, and ``g`` (model, chunk, x), the longest run of each chunk of these models."""
    names = ", ".join(f"'{m}'" for m in models)
    return f"""
s AS (SELECT theme || '-' || sample_idx || '-' || chunk_idx AS theme, model, seq FROM seqs),
a AS (SELECT model, theme AS chunk, k, seq[k] AS v FROM (SELECT model, theme, seq, unnest(range(1, len(seq) + 1)) AS k FROM s WHERE model IN ({names}))),
b AS (SELECT theme AS piece, k, seq[k] AS v FROM (SELECT theme, seq, unnest(range(1, len(seq) + 1)) AS k FROM s WHERE model = '{REAL}')),
m AS (SELECT model, chunk, piece, a.k AS i, a.k - b.k AS diag FROM a JOIN b USING (v)),
r AS (SELECT model, chunk, piece, diag, i - row_number() OVER (PARTITION BY model, chunk, piece, diag ORDER BY i) AS island FROM m),
l AS (SELECT model, chunk, max(n) AS lcs FROM (SELECT model, chunk, count(*) AS n FROM r GROUP BY model, chunk, piece, diag, island) GROUP BY ALL),
g AS (SELECT s.model, theme AS chunk, coalesce(lcs, 0)::DOUBLE AS x FROM s LEFT JOIN l ON s.model = l.model AND s.theme = l.chunk WHERE s.model IN ({names}) AND len(seq) > 0)"""


LCS_NUMBERS = "count(x) AS n_gen_chunks_lcs, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, min(x) AS min, max(x) AS max"


@query("lcs_runs", with_ctes(NOTES, SEQUENCES, lcs_sql(GENERATED)) + " SELECT model, chunk, x::BIGINT AS lcs FROM g")
def lcs_runs(spark, d):
    generated, train = _corpora(spark, d)
    return copying.longest_common_runs(generated.where(F.size("seq") > 0), train)


@query("lcs_max_stats", with_ctes(NOTES, SEQUENCES, lcs_sql(GENERATED)) + f""" SELECT model, n_gen_chunks, n_gen_chunks_lcs, {EIGHT.replace('n, ', '', 1)} FROM
(SELECT model, count(*) AS n_gen_chunks FROM s WHERE model <> '{REAL}' GROUP BY 1) LEFT JOIN (SELECT model, {LCS_NUMBERS} FROM g GROUP BY 1) USING (model)""")
def lcs_stats(spark, d):
    out = copying.lcs_summary(*_corpora(spark, d))
    return out.select("model", "n_gen_chunks", "n_gen_chunks_lcs", *[F.round(c, 12).alias(c) for c in ("mean", "std", "median", "p25", "p75", "min", "max")])


BAR = ["model", "user_id", "bar"]
PATTERNS = """
slots AS (
  SELECT model, user_id, bar, slot, max(CASE WHEN slot = onset THEN 'O' ELSE 'H' END) AS mark
  FROM (SELECT *, unnest(range(onset, least(onset + n - 1, 15) + 1)) AS slot FROM (SELECT model, user_id, bar, round_even(offset_q * 4, 0)::INTEGER AS onset, greatest(1, round_even(length_q * 4, 0)::INTEGER) AS n FROM measures WHERE pitch IS NOT NULL) WHERE onset >= 0 AND onset < 16)
  GROUP BY ALL
),
patterns AS (
  SELECT model, user_id, bar, string_agg(coalesce(mark, 'R'), '' ORDER BY slot) AS pattern
  FROM (SELECT DISTINCT model, user_id, bar FROM measures) CROSS JOIN (SELECT unnest(range(16)) AS slot) LEFT JOIN slots USING (model, user_id, bar, slot) GROUP BY ALL
)"""


def _patterns(spark, d) -> DataFrame:
    return domain.bar_patterns(measure_events(spark, d), BAR)


@query("bar_patterns", with_ctes(MEASURES, PATTERNS) + " SELECT model, user_id, bar, pattern FROM patterns")
def bar_patterns(spark, d):
    return _patterns(spark, d)


@query("bar_pattern_counts", with_ctes(MEASURES, PATTERNS) + " SELECT model, pattern, count(*) AS n FROM patterns GROUP BY ALL")
def bar_pattern_counts(spark, d):
    return _patterns(spark, d).groupBy("model", "pattern").agg(F.count(F.lit(1)).alias("n"))


JSD = with_ctes(MEASURES, PATTERNS) + f""",
p AS (SELECT pattern, count(*) AS np FROM patterns WHERE model = '{REAL}' GROUP BY 1),
q AS (SELECT model, pattern, count(*) AS nq FROM patterns WHERE model <> '{REAL}' GROUP BY ALL),
m AS (SELECT model, pattern, np, nq FROM (SELECT model, pattern, np FROM p, (SELECT DISTINCT model FROM q)) FULL JOIN q USING (model, pattern)),
f AS (SELECT *, coalesce(np, 0)::DOUBLE / (SELECT sum(np) FROM p)::DOUBLE AS a, coalesce(nq, 0)::DOUBLE / (sum(nq) OVER (PARTITION BY model))::DOUBLE AS b FROM m)
SELECT model, round(sum(CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END) * 0.5::DOUBLE + sum(CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END) * 0.5::DOUBLE, 6) AS jsd,
       (SELECT sum(np) FROM p)::BIGINT AS n_real, sum(nq)::BIGINT AS n_gen, count(np) AS n_unique_real, count(nq) AS n_unique_gen, count(*) AS n_unique_union FROM f GROUP BY 1"""


def _jsd(spark, d, models: list[str] = GENERATED) -> DataFrame:
    rows = _patterns(spark, d)
    return divergence.jensen_shannon(rows.where(F.col("model") == REAL), rows.where(F.col("model").isin(models)), "pattern")


@query("bar_rhythm_jsd", JSD)
def bar_rhythm_jsd(spark, d):
    return _jsd(spark, d).withColumn("jsd", F.round("jsd", 6))


# --- final tables -------------------------------------------------------------------------------

#: The part of the final table that rests on segments.
SEGMENT_METRICS = tuple(m for m in summary.FINAL_METRICS if m[2] == "aggregates")


def _final(spark, d) -> DataFrame:
    found = seg.aggregates(_per_segment(spark, d)).withColumnRenamed("metric", "key")
    master = summary.master_rows(found, "aggregates", "key", SEGMENT_METRICS)
    return summary.final_table(master, MODELS, SEGMENT_METRICS)


NAMES = ", ".join(f"({k}, '{m[0]}', '{m[3]}')" for k, m in enumerate(SEGMENT_METRICS))
FINAL = ALL + ", " + LONG + f""",
stats AS (SELECT model, metric AS key, {NUMBERS} FROM means GROUP BY ALL),
final AS (SELECT ord, v.metric, model, 'A' AS grp, mean, std, median, p25, p75, min, max FROM (VALUES {NAMES}) v(ord, metric, key) JOIN stats USING (key))"""


@query("master_final_table", FINAL + " SELECT model, metric, grp, " + EIGHT.removeprefix("n, ") + ", NULL::DOUBLE AS kl, NULL::DOUBLE AS oa, NULL::DOUBLE AS value FROM final")
def master_final_table(spark, d):
    out = _final(spark, d)
    return out.select("model", "metric", "grp", *[F.round(c, 12).alias(c) for c in summary.STATS])


_F = "CASE WHEN {0} IS NULL THEN '—' ELSE printf('%.3f', {0}) END"
_CELL = "'mean = ' || " + _F.format("mean") + " || ' ± ' || " + _F.format("std") + " || chr(10) || 'median = ' || " + _F.format("median") + " || ' (' || " + _F.format("p25") + " || '–' || " + _F.format("p75") + " || ')'"


@query("final_human_pivot", FINAL + " SELECT metric, " + ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN {_CELL} END), '') AS \"{m}\"" for m in MODELS) + " FROM final GROUP BY ord, metric ORDER BY ord")
def final_human_pivot(spark, d):
    return summary.human_table(_final(spark, d), MODELS, SEGMENT_METRICS)


# --- all four groups ----------------------------------------------------------------------------


def plagiarism_sql(models: list[str]) -> str:
    """CTEs from ``seqs`` that end in ``copied``, a row per model."""
    names = ", ".join(f"'{m}'" for m in models)
    grams = lambda n: f"SELECT model, {n} AS size, seq[k:k + {n - 1}] AS gram FROM (SELECT model, seq, unnest(range(1, greatest(1, len(seq) - {n - 2}))) AS k FROM seqs)"
    wide = ", ".join(f"max(overlap) FILTER (size = {n}) AS ngram_overlap_n{n}, max(n) FILTER (size = {n}) AS n_gen_ngrams_n{n}" for n in copying.SIZES)
    return f"""{lcs_sql(models)},
grams AS ({" UNION ALL ".join(grams(n) for n in copying.SIZES)}),
pools AS (SELECT model, size, count(*) AS n, count(train.gram)::DOUBLE / count(*) AS overlap FROM (SELECT * FROM grams WHERE model IN ({names})) LEFT JOIN (SELECT DISTINCT size, gram FROM grams WHERE model = '{REAL}') train USING (size, gram) GROUP BY ALL),
copied AS (SELECT * FROM (SELECT model, {wide} FROM pools GROUP BY 1) JOIN (SELECT model, count(*) AS n_gen_chunks FROM s GROUP BY 1) USING (model) JOIN (SELECT model, {LCS_NUMBERS} FROM g GROUP BY 1) USING (model))"""


def plagiarism_rows(spark, d, models: list[str]) -> DataFrame:
    return copying.plagiarism(*_corpora(spark, d, models), models)


SHARES = [f"ngram_overlap_n{n}" for n in copying.SIZES]
SEVEN = summary.STATS[:7]


@query("plagiarism_driver", with_ctes(NOTES, SEQUENCES, plagiarism_sql(GENERATED)) + f""" SELECT model, {", ".join(f"round({c}, 9) AS {c}" for c in SHARES)}, {", ".join(f"round({c}, 9) AS lcs_max_{c}" for c in SEVEN)},
n_gen_chunks, n_gen_chunks_lcs, {", ".join(f"n_gen_ngrams_n{n}" for n in copying.SIZES)}, (SELECT count(*) FROM s WHERE model = '{REAL}') AS n_train_pieces FROM copied""")
def plagiarism_driver(spark, d):
    out = plagiarism_rows(spark, d, GENERATED)
    return out.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def full_table(spark, d) -> DataFrame:
    """The final table of all metrics and models; the real pieces stand for one of the models too."""
    from .corpora import features_against_real

    found = seg.aggregates(_per_segment(spark, d)).withColumnRenamed("metric", "key")
    copied = written(plagiarism_rows(spark, d, MODELS))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in SHARES])).alias("v")
    parts = [
        summary.master_rows(found, "aggregates", "key"),
        summary.master_rows(features_against_real(spark, d, MODELS).withColumnRenamed("feature", "key"), "mgeval", "key"),
        summary.master_rows(_jsd(spark, d, MODELS).select("model", F.lit("jsd").alias("key"), F.col("jsd").alias("value")), "bar_rhythm_jsd", "key"),
        summary.master_rows(copied.select("model", values).select("model", "v.key", "v.value"), "plagiarism", "key"),
        summary.master_rows(copied.select("model", F.lit("lcs_max").alias("key"), *[F.col(f"lcs_max_{c}").alias(c) for c in SEVEN]), "plagiarism", "key"),
    ]
    return summary.final_table(reduce(DataFrame.unionByName, [written(p) for p in parts]), MODELS)


def _full_sql() -> str:
    """The whole final table: the CTEs of all four groups, each in a subquery of its own."""
    from .corpora import features_sql

    blank = ", ".join(f"NULL::DOUBLE AS {c}" for c in SEVEN)
    aggregates = f"{ALL}, {LONG} SELECT 'aggregates' AS source, model, metric AS key, mean, std, median, p25, p75, min, max, NULL::DOUBLE AS kl, NULL::DOUBLE AS oa, NULL::DOUBLE AS value FROM (SELECT model, metric, {NUMBERS} FROM means GROUP BY ALL)"
    features = f"{features_sql(MODELS)} SELECT 'mgeval', model, grp, {blank}, kl, oa, NULL FROM measured"
    rhythm = JSD.split("\nSELECT")[0].replace(f"WHERE model <> '{REAL}'", "") + f" SELECT 'bar_rhythm_jsd', model, 'jsd', {blank}, NULL, NULL, sum(CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END) * 0.5::DOUBLE + sum(CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END) * 0.5::DOUBLE FROM f GROUP BY model"
    copied = f"""{with_ctes(NOTES, SEQUENCES, plagiarism_sql(MODELS))} SELECT 'plagiarism', model, 'lcs_max', {", ".join(SEVEN)}, NULL, NULL, NULL FROM copied
UNION ALL SELECT 'plagiarism', model, key, {blank}, NULL, NULL, value FROM (UNPIVOT (SELECT model, {", ".join(SHARES)} FROM copied) ON {", ".join(SHARES)} INTO NAME key VALUE value)"""
    wanted = ", ".join(f"({k}, '{m[0]}', '{m[1]}', '{m[2]}', '{m[3]}')" for k, m in enumerate(summary.FINAL_METRICS))
    cell = f"CASE WHEN grp IN ('A', 'D') THEN {_CELL} WHEN grp = 'B' THEN 'KL = ' || {_F.format('kl')} || chr(10) || 'OA = ' || {_F.format('oa')} ELSE {_F.format('value')} END"
    return f"""SELECT metric, {", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN {cell} END), '') AS \"{m}\"" for m in MODELS)}
FROM (VALUES {wanted}) v(ord, metric, grp, source, key) JOIN (
(SELECT * FROM ({aggregates})) UNION ALL (SELECT * FROM ({features})) UNION ALL (SELECT * FROM ({rhythm})) UNION ALL (SELECT * FROM ({copied}))) found USING (source, key)
GROUP BY ord, metric ORDER BY ord"""


@query("final_human_all_groups", _full_sql())
def final_human_all_groups(spark, d):
    return summary.human_table(full_table(spark, d), MODELS)


# --- the whole phase ----------------------------------------------------------------------------


def reports(spark, d, models: list[str]) -> list[phase.Report]:
    """The corpus measures of a run, with the fixed columns of their files."""
    from .corpora import features_against_real

    seven = ", ".join(f"lcs_max_{s} double" for s in SEVEN)
    return [
        phase.Report(
            "mgeval", "feature string, model string, kl double, oa double, n_real_pieces long, n_gen_pieces long", lambda: features_against_real(spark, d, models), ("feature", "model"),
            lambda df: df.withColumnRenamed("feature", "key"),
        ),
        phase.Report(
            "bar_rhythm_jsd", "model string, jsd double, n_real long, n_gen long, n_unique_real long, n_unique_gen long, n_unique_union long", lambda: _jsd(spark, d, models), ("model",),
            lambda df: phase.wide_values(df, ["jsd"]),
        ),
        phase.Report(
            "plagiarism", f"model string, {', '.join(f'{s} double' for s in SHARES)}, {seven}, n_gen_chunks long, n_gen_chunks_lcs long, {', '.join(f'n_gen_ngrams_n{n} long' for n in copying.SIZES)}, n_train_pieces long",
            lambda: plagiarism_rows(spark, d, models), ("model",),
            lambda df: phase.wide_values(df, SHARES).unionByName(phase.wide_numbers(df, "lcs_max", "lcs_max"), allowMissingColumns=True),
        ),
    ]


@query("metrics_phase", _full_sql())
def metrics_phase(spark, d):
    """All reports of a run written as CSVs, the final table built from what is read back, and read back itself."""
    folder = f"{shared_folder(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    return phase.run(_per_segment(spark, d), reports(spark, d, MODELS), folder, MODELS)
