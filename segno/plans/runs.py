"""Work lists, status, samples, studies, logs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segno.operators import relational, sampling, state
from segno.shared import shared_folder
from segno.sources.tables import curve_summary, loss_curve
from segno.streaming import streams

from .bindings import table, with_ctes
from .book import query

NAMES = ["alto", "tenor", "baritone"]


def _themes(spark, d) -> DataFrame:
    rows = table(spark, d, "supplier")
    return rows.select(F.col("s_suppkey").cast("string").alias("theme"), (F.col("s_suppkey") % 13 == 5).alias("removed"), (F.col("s_suppkey") % 7).cast("int").alias("chunks"))


def _samples(spark, d) -> DataFrame:
    """Two samples of three models for most themes; some fail, some are missing."""
    expected = state.expected_samples(_themes(spark, d), NAMES, 2)
    code = F.col("theme").cast("long") * 5 + F.length("model") * 3 + F.col("sample_idx") * 2
    rows = expected.withColumn("code", code).where("code % 9 <> 4")
    return rows.select("theme", "model", "sample_idx", (F.col("code") % 11 != 3).alias("ok"), F.when((F.col("code") % 11 == 3) & (F.col("code") % 2 == 0), "bad output").alias("error"), F.lit("2024-01-01T00:00:00Z").alias("ts"))


def _files(spark, d) -> DataFrame:
    rows = _samples(spark, d)
    return rows.where((F.col("theme").cast("long") + F.length("model")) % 4 != 1).select("theme", "model", "sample_idx")


STATE = """
themes AS (SELECT s_suppkey::VARCHAR AS theme, s_suppkey % 13 = 5 AS removed, (s_suppkey % 7)::INTEGER AS chunks FROM supplier),
models AS (SELECT * FROM (VALUES ('alto', 0), ('tenor', 1), ('baritone', 2)) v(model, ord)),
expected AS (SELECT theme, model, ord, sample_idx, chunks, theme::BIGINT * 5 + length(model) * 3 + sample_idx * 2 AS code FROM themes, models, (SELECT unnest(range(2))::INTEGER AS sample_idx)),
samples AS (SELECT theme, model, sample_idx, code % 11 <> 3 AS ok, CASE WHEN code % 11 = 3 AND code % 2 = 0 THEN 'bad output' END AS error FROM expected WHERE code % 9 <> 4),
files AS (SELECT theme, model, sample_idx FROM samples WHERE (theme::BIGINT + length(model)) % 4 <> 1)"""


@query("worklist_anti", with_ctes(STATE) + " SELECT theme, model, sample_idx, theme || '/' || sample_idx AS task_id, 42 + sample_idx AS seed FROM expected WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.theme = expected.theme AND s.model = expected.model AND s.sample_idx = expected.sample_idx AND s.ok) AND NOT EXISTS (SELECT 1 FROM files s WHERE s.theme = expected.theme AND s.model = expected.model AND s.sample_idx = expected.sample_idx)")
def work_list(spark, d):
    expected = state.expected_samples(_themes(spark, d), NAMES, 2)
    return state.work_list(expected, _samples(spark, d), _files(spark, d)).select(*state.SAMPLE, "task_id", "seed")


@query("derived_status", with_ctes(STATE) + """,
m AS (SELECT theme, model, ord, coalesce(n, 0) >= 2 AND coalesce(all_ok, true) AS ok FROM themes CROSS JOIN models LEFT JOIN (SELECT theme, model, count(*) AS n, bool_and(ok) AS all_ok FROM samples GROUP BY ALL) USING (theme, model)),
t AS (SELECT theme, bool_and(ok) AS all_ok, min_by(model, ord) FILTER (NOT ok) AS failing FROM m GROUP BY 1)
SELECT theme, CASE WHEN removed OR NOT all_ok THEN 'fail' ELSE 'ok' END AS status, CASE WHEN removed THEN 'removed_from_corpus' WHEN NOT all_ok THEN failing END AS excluded_due_to FROM themes JOIN t USING (theme)""")
def derived_status(spark, d):
    return state.derived_status(_themes(spark, d), _samples(spark, d), NAMES, 2)


@query("active_themes", with_ctes(STATE) + " SELECT status, count(*) AS n FROM (SELECT theme, CASE WHEN removed OR NOT coalesce(good, false) THEN 'fail' ELSE 'ok' END AS status FROM themes LEFT JOIN (SELECT theme, count(*) = 6 AND bool_and(ok) AS good FROM samples GROUP BY 1) USING (theme)) GROUP BY 1")
def active_themes(spark, d):
    return state.derived_status(_themes(spark, d), _samples(spark, d), NAMES, 2).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("self_heal_transitions", with_ctes(STATE) + f"""
SELECT theme, model, sample_idx, coalesce((CASE WHEN chunks = 0 THEN false WHEN f THEN true WHEN s.ok THEN false ELSE s.ok END)::VARCHAR, 'unset') AS ok,
       CASE WHEN chunks = 0 THEN 'theme too short' WHEN f THEN NULL WHEN s.ok THEN '{state.MISSING}' ELSE s.error END AS error
FROM expected LEFT JOIN samples s USING (theme, model, sample_idx) LEFT JOIN (SELECT *, true AS f FROM files) USING (theme, model, sample_idx)""")
def self_heal(spark, d):
    themes = _themes(spark, d)
    healed, _ = state.self_heal(themes, state.expected_samples(themes, NAMES, 2), _samples(spark, d), _files(spark, d), themes)
    return healed.withColumn("ok", F.coalesce(F.col("ok").cast("string"), F.lit("unset")))


@query("complete_samples", with_ctes(STATE) + " SELECT theme, model, sample_idx, bool_and(f IS NOT NULL) AS complete FROM (SELECT theme, model, sample_idx, unnest(range(greatest(chunks, 1)))::INTEGER AS chunk_idx FROM expected) LEFT JOIN (SELECT *, 1 AS f, unnest(range(2))::INTEGER AS chunk_idx FROM files) USING (theme, model, sample_idx, chunk_idx) GROUP BY ALL")
def complete(spark, d):
    expected = state.expected_samples(_themes(spark, d), NAMES, 2).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.col("chunks"), F.lit(1)) - 1)))
    there = _files(spark, d).withColumn("chunk_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    return state.complete_samples(expected, there)


@query("failures_report", with_ctes(STATE) + " SELECT printf('%-30s sample_%d %-8s — %s', theme, sample_idx, model, coalesce(nullif(error, ''), 'unknown')) AS value FROM samples JOIN themes USING (theme) WHERE NOT ok AND NOT removed")
def failures(spark, d):
    return state.failures(_samples(spark, d), _themes(spark, d))


@query("upsert_latest", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert(spark, d):
    return relational.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


# --- samples and studies ------------------------------------------------------------------------

SEEDS = list(range(1000, 1020))


@query("split_80_10_10", """
WITH r AS (SELECT o_orderkey::VARCHAR AS name, row_number() OVER (ORDER BY md5('0-' || o_orderkey), o_orderkey::VARCHAR) AS k, count(*) OVER () AS n FROM orders)
SELECT name, CASE WHEN k <= n // 10 THEN 'eval' WHEN k <= 2 * (n // 10) THEN 'test' ELSE 'train' END AS bucket FROM r WHERE NOT (name IN ('1', '2', '3') AND k > n // 10 AND k <= 2 * (n // 10))""")
def split(spark, d):
    names = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("name"))
    return sampling.split(names, "name", 0, 0.1, ["1", "2", "3"])


@query("bootstrap_summary", f"""
WITH t AS (SELECT trial, o_orderstatus AS status, o_totalprice, row_number() OVER (PARTITION BY trial, o_orderstatus ORDER BY md5(trial || '-' || o_orderkey), o_orderkey) AS k FROM orders, (SELECT unnest({SEEDS}) AS trial)),
m AS (SELECT trial, status, sum(o_totalprice) / count(*) AS x FROM t WHERE k <= 15 GROUP BY ALL)
SELECT status, count(*) AS n_trials, round(avg(x), 4) AS x_mean, round(stddev_pop(x), 4) AS x_std, round(min(x), 4) AS x_min, round(max(x), 4) AS x_max FROM m GROUP BY 1""")
def bootstrap(spark, d):
    parts = []
    for status in ("O", "F", "P"):
        own = table(spark, d, "orders").where(F.col("o_orderstatus") == status)
        parts.append(sampling.trials(own, "o_orderkey", 15, SEEDS))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    means = rows.groupBy("trial", F.col("o_orderstatus").alias("status")).agg((F.sum("o_totalprice") / F.count(F.lit(1))).alias("x"))
    out = sampling.trial_summary(means, ["status"], ["x"])
    return out.select("status", "n_trials", *[F.round(c, 4).alias(c) for c in ("x_mean", "x_std", "x_min", "x_max")])


@query("half_split_noise", """
WITH t AS (SELECT trial, o_totalprice, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '-' || o_orderkey), o_orderkey) <= (count(*) OVER (PARTITION BY trial)) // 2 AS a FROM orders, (SELECT unnest([42, 123, 7, 999, 2024]) AS trial))
SELECT trial, round(abs(avg(o_totalprice) FILTER (a) - avg(o_totalprice) FILTER (NOT a)), 4) AS gap FROM t GROUP BY 1""")
def half_split(spark, d):
    cut = sampling.halves(table(spark, d, "orders"), "o_orderkey", [42, 123, 7, 999, 2024])
    gap = F.abs(F.avg(F.when(F.col("half") == "a", F.col("o_totalprice"))) - F.avg(F.when(F.col("half") == "b", F.col("o_totalprice"))))
    return cut.groupBy("trial").agg(F.round(gap, 4).alias("gap"))


@query("seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5('42-' || c_custkey), c_custkey LIMIT 15")
def seeded_sample(spark, d):
    return sampling.sample(table(spark, d, "customer"), "c_custkey", 15, 42).select("c_custkey")


@query("paired_inner", "SELECT a.l_orderkey AS name, a.n AS n_a, r.n AS n_r FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r USING (l_orderkey)")
def paired_inner(spark, d):
    """Pieces for which both models have a result: one aggregation instead of a join of two."""
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    got = rows.groupBy(F.col("l_orderkey").alias("name")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n_a"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"))
    return got.where("n_a > 0 and n_r > 0")


@query("dropped_report", "SELECT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dropped(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("name")).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name")), "name", "left_anti")


@query("wide_outer_merge", "SELECT coalesce(a.k, b.k) AS feature, coalesce(a.n::VARCHAR, '') AS orders, coalesce(b.n::VARCHAR, '') AS supplies FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def wide_merge(spark, d):
    """Two tables of one key side by side: a key that only one of them has keeps an empty cell."""
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("feature")).agg(F.count(F.lit(1)).cast("string").alias("orders"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(F.count(F.lit(1)).cast("string").alias("supplies"))
    return a.join(b, "feature", "full").na.fill("", ["orders", "supplies"])


@query("union_stitch", "SELECT l_partkey AS id, 'single' AS part FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, 'bootstrap' FROM lineitem WHERE l_returnflag <> 'A'")
def union_stitch(spark, d):
    """Features of one group from one table, those of the others from another."""
    rows = table(spark, d, "lineitem")
    a = rows.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("id"), F.lit("single").alias("part"))
    return a.unionByName(rows.where("l_returnflag <> 'A'").select(F.col("l_partkey").alias("id"), F.lit("bootstrap").alias("part")))


@query("unpivot_pivot_round", "SELECT metric, max(value) FILTER (model = 'A') AS \"A\", max(value) FILTER (model = 'N') AS \"N\", max(value) FILTER (model = 'R') AS \"R\" FROM (SELECT l_returnflag AS model, unnest(['quantity', 'lines']) AS metric, unnest([sum(l_quantity), count(*)::DOUBLE]) AS value FROM lineitem GROUP BY 1) GROUP BY 1")
def unpivot_pivot(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"))
    long = relational.unpivot(wide, ["model"], ["quantity", "lines"], "metric", "value")
    return long.groupBy("metric").pivot("model", ["A", "N", "R"]).agg(F.max("value"))


# --- logs ---------------------------------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    """A training log for each user: sign-ups are epoch headers, clicks report a value."""
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("Epoch "), F.col("event_id"), F.lit("/9"))).when(F.col("event_type") == "click", F.format_string("nll/eval: %.2f", "value")).otherwise(F.lit("..."))
    return table(spark, d, "events").select("user_id", "event_id", text.alias("line"))


LOG = """
l AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN event_id END AS e, CASE event_type WHEN 'click' THEN value END AS v FROM events),
s AS (SELECT *, count(e) OVER w AS grp, last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
curve AS (SELECT user_id, epoch::INTEGER AS epoch, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) AS k FROM s WHERE v IS NOT NULL AND epoch IS NOT NULL) WHERE k = 1)"""


def _curve(spark, d) -> DataFrame:
    return loss_curve(_log(spark, d), ["user_id"], "event_id", r"^Epoch (\d+)", r"^nll/eval: ([-\d.]+)")


@query("log_state_machine", with_ctes(LOG) + " SELECT user_id, epoch, round(value, 2) AS value FROM curve")
def log_machine(spark, d):
    return _curve(spark, d)


@query("curve_summary", with_ctes(LOG) + """,
c AS (SELECT user_id, epoch, round(value, 2) AS value FROM curve)
SELECT user_id, min(value) AS best, (list(epoch ORDER BY value, epoch)[1]) AS best_epoch, max_by(value, epoch) AS final, round(max_by(value, epoch) - min(value), 6) AS gap, round((max_by(value, epoch) - min(value)) * 100 / min(value), 4) AS gap_percent FROM c GROUP BY 1""")
def summary_of_curve(spark, d):
    return curve_summary(_curve(spark, d), ["user_id"]).withColumn("gap", F.round("gap", 6)).withColumn("gap_percent", F.round("gap_percent", 4))


# --- streams ------------------------------------------------------------------------------------


@query("stream_tumbling_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, d):
    """Events as a stream with a watermark: windowed counts in its state, upserted batch by batch."""
    run = _run_folder(spark)
    return streams.upsert_counts(_event_stream(spark, d), f"{run}/out", f"{run}/state")


def _run_folder(spark) -> str:
    """A new folder for a stream's output and state, shared by driver and executors."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, d) -> DataFrame:
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark wants an instant


@query("stream_dedupe", "SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedupe(spark, d):
    """Each user and type of a stream, told once in all: what the state forgot behind the watermark is met again in the output.

    The state holds the keys of the last half year of events; the output, which is read back, has the rest.
    """
    run = _run_folder(spark)
    rows = _event_stream(spark, d).select("ts", "user_id", "event_type")
    streams.run_available(streams.without_repeats(rows, ["user_id", "event_type"], late="180 days").drop("ts"), f"{run}/out", f"{run}/state")
    return spark.read.parquet(f"{run}/out").distinct()


@query("tumbling_window_batch", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_batch(spark, d):
    return streams.tumbling_counts(table(spark, d, "events"))
