"""Files of a run, written from the test tables and read back: reports, splits, manifests, tasks and results, skips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segno.operators import loading, sampling, state
from segno.shared import shared_folder
from segno.sources import sinks, sqlite_source, tables
from segno.streaming import streams

from .bindings import table, with_ctes
from .book import query
from .runs import NAMES, STATE, _samples, _themes
from .studies import PARSED, _parsed


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT o_orderpriority AS priority, count(*) AS n, printf('%.6f', avg(o_totalprice))::DOUBLE AS mean, CASE WHEN o_orderpriority LIKE '%H' THEN 'a \"quoted\", text' END AS note FROM orders GROUP BY ALL")
def csv_round_trip(spark, d):
    """A report as one CSV with six places, read back under its schema; empty cells are null."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))
    rows = rows.withColumn("note", F.when(F.col("priority").endswith("H"), 'a "quoted", text'))
    path = f"{_folder(spark, 'csv')}/report.csv"
    sinks.write_csv(rows, path, ["priority"])
    return tables.read_csv(spark, path, "priority string, n long, mean double, note string")


@query("split_round_trip", """
WITH r AS (SELECT s_suppkey::VARCHAR AS name, row_number() OVER (ORDER BY md5('0-' || s_suppkey), s_suppkey::VARCHAR) AS k, count(*) OVER () AS n FROM supplier)
SELECT name, CASE WHEN k <= n // 10 THEN 'eval' WHEN k <= 2 * (n // 10) THEN 'test' ELSE 'train' END AS bucket, false AS twice FROM r""")
def split_round_trip(spark, d):
    """A split as a JSON file, read back, and whether a name stands in two of its lists."""
    names = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("name"))
    path = f"{_folder(spark, 'split')}/split.json"
    sinks.write_split(sampling.split(names, "name", 0, 0.1), path)
    held = tables.read_split(spark, path)
    twice = state.drop_split(held).select("name", F.lit(True).alias("twice"))
    return held.join(twice, "name", "left").select("name", "bucket", F.coalesce("twice", F.lit(False)).alias("twice"))


@query("manifest_round_trip", with_ctes(STATE) + " SELECT theme, model, sample_idx, ok, error, '2024-01-01T00:00:00Z' AS ts, removed FROM samples JOIN themes USING (theme)")
def manifest_round_trip(spark, d):
    """The state of a run as one JSON file, read back as themes and samples."""
    path = f"{_folder(spark, 'manifest')}/manifest.json"
    themes = _themes(spark, d).withColumn("status", F.lit("ok"))
    sinks.write_manifest(themes, _samples(spark, d).withColumn("duration_sec", F.lit(1.5)), path, schema_version=1, slug="test")
    held, samples = tables.read_manifest(spark, path, NAMES)
    return samples.join(held.select("theme", "removed"), "theme").select("theme", "model", "sample_idx", "ok", "error", "ts", "removed")


ANSWERS = """
tasks AS (SELECT c_custkey AS k, 'task/' || c_custkey AS task_id FROM customer),
results AS (SELECT 'task/' || o_custkey AS task_id, o_orderstatus = 'F' AS ok, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS error, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS part, o_orderkey AS k FROM orders),
last AS (SELECT task_id, max(part) AS part FROM results GROUP BY 1),
one AS (SELECT task_id, bool_and(ok) AS ok, max(error) AS error FROM results JOIN last USING (task_id, part) GROUP BY 1)"""


@query("task_results", with_ctes(ANSWERS) + " SELECT task_id, coalesce(ok, false) AS ok, CASE WHEN o.task_id IS NULL THEN 'subprocess_died' ELSE error END AS error FROM tasks LEFT JOIN (SELECT * FROM one) o USING (task_id)")
def task_results(spark, d):
    """Tasks and results as JSON lines; the last result of a task counts, and a task without one died.

    Results of a task are pooled for each of two files, as lines of one file have an order that SQL does not know.
    """
    folder = _folder(spark, "tasks")
    customers = table(spark, d, "customer")
    name = F.concat(F.lit("task/"), F.col("c_custkey").cast("string"))
    asked = customers.select(name.alias("task_id"), F.lit("theme.xml").alias("input"), F.lit("out").alias("output_dir"), name.alias("output_stem"), F.lit(42).alias("seed"), F.lit(8).alias("input_bars"), F.lit(8).alias("output_bars"))
    sinks.write_json_lines(asked, f"{folder}/tasks")
    orders = table(spark, d, "orders")
    later = (F.col("o_orderkey") % 3 == 0).cast("int")
    held = orders.select(F.concat(F.lit("task/"), F.col("o_custkey").cast("string")).alias("task_id"), (F.col("o_orderstatus") == "F").alias("ok"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("error"), later.alias("part"))
    pooled = held.groupBy("task_id", "part").agg(F.bool_and("ok").alias("ok"), F.max("error").alias("error"))
    for part in (0, 1):
        sinks.write_json_lines(pooled.where(F.col("part") == part).drop("part"), f"{folder}/results/part={part}")
    got = state.with_results(tables.read_tasks(spark, f"{folder}/tasks"), tables.read_results(spark, f"{folder}/results"))
    return got.select("task_id", "ok", "error")


@query("streamed_results", "SELECT user_id::VARCHAR || '/' || event_type AS task_id, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY ALL")
def streamed_results(spark, d):
    """Results that arrive in three portions, handed batch by batch to a sink that lays them down, then upserted."""
    folder = _folder(spark, "stream")
    rows = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("task_id"), "event_id")

    def keep(batch, number):
        batch.groupBy("task_id").agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).write.parquet(f"{folder}/in/part={part}")
        arrived = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        streams.append_results(arrived, keep, f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("task_id").agg(F.max("last_event").alias("last_event"), F.sum("n").alias("n"))


@query("skipped_pieces", with_ctes(PARSED) + " SELECT status, count(*) AS n FROM status GROUP BY 1 UNION ALL SELECT 'notes', sum(n)::BIGINT FROM status WHERE status = 'ok'")
def skipped_pieces(spark, d):
    """How many pieces a training run took and left, counted by an observation while the pieces were written."""
    held, seen = loading.observed_status(*_parsed(spark, d))
    path = _folder(spark, "pieces")
    held.write.parquet(path)
    counts = [(k, v) for k, v in seen.get.items() if v]
    notes = spark.read.parquet(path).agg(F.sum(F.size("pitches")).cast("long").alias("n")).select(F.lit("notes").alias("status"), "n")
    return spark.createDataFrame(counts, "status string, n long").unionByName(notes)


@query("utc_texts", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_texts(spark, d):
    return table(spark, d, "events").select("event_id", sinks.utc_text(F.col("ts")).alias("at"))


@query("sqlite_scan", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier WHERE s_nationkey >= 5")
def sqlite_scan(spark, d):
    """A table of a SQLite database, written by one task and scanned by ranges of rows, with the filter in the scan."""
    folder = _folder(spark, "database")
    sinks.replace(spark, f"{folder}/made", "")  # makes the folder
    path = f"{folder}/supplier.db"
    sqlite_source.write_table(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal")), path, "supplier")
    sqlite_source.register(spark)
    rows = spark.read.format("segno_sqlite").option("table", "supplier").option("partition_rows", 64).load(path)
    return rows.where("s_nationkey >= 5")
