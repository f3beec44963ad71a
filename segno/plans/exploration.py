"""Distributions and cross-tables of a corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from segno.functions import music
from segno.operators import relational as rel

from .bindings import NOTES, notes, table, with_ctes
from .book import query

ORDERED = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


@query("notes_per_piece", "SELECT l_suppkey AS piece, count(*) AS n FROM lineitem GROUP BY 1")
def notes_per_piece(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("piece")).agg(F.count(F.lit(1)).alias("n"))


@query("piece_span", "SELECT l_suppkey AS piece, max(l_linenumber) - min(l_linenumber) + 1 AS bars, round_even(max(l_quantity) - min(l_quantity), 0)::INTEGER AS pitch_range FROM lineitem GROUP BY 1")
def piece_span(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("piece"))
    return rows.agg((F.max("l_linenumber") - F.min("l_linenumber") + 1).alias("bars"), music.half_even(F.max("l_quantity") - F.min("l_quantity")).alias("pitch_range"))


@query("ordered_projection", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def ordered_projection(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("interval_histogram", with_ctes(NOTES) + """
SELECT interval, count(*) AS n FROM (
  SELECT greatest(-24, least(24, pitch - lag(pitch) OVER (PARTITION BY theme, model, sample_idx, chunk_idx ORDER BY seq_no))) AS interval,
         lag(pitch) OVER (PARTITION BY theme, model, sample_idx, chunk_idx ORDER BY seq_no) AS p FROM notes) WHERE p IS NOT NULL GROUP BY 1""")
def interval_histogram(spark, d):
    steps = rel.differences(notes(spark, d), ["theme", "model", "sample_idx", "chunk_idx"], ["seq_no"], "pitch", "step")
    return steps.groupBy(music.clipped(F.col("step"), -24, 24).alias("interval")).agg(F.count(F.lit(1)).alias("n"))


CHANGES = """
WITH c AS (SELECT event_type, value, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_type AS chord, count(*) AS n FROM c WHERE (k = 1 OR event_type IS DISTINCT FROM before) AND trim(event_type) <> '' GROUP BY 1 ORDER BY n DESC, chord LIMIT 20"""


@query("chord_change_vocab_topn", CHANGES)
def chord_change_vocab(spark, d):
    moves = rel.changes(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").where(F.trim("event_type") != "")
    return rel.top_n(moves.groupBy(F.col("event_type").alias("chord")).agg(F.count(F.lit(1)).alias("n")), 20, "n", "chord")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["O", "F", "P"]


@query("family_style_crosstab", "SELECT f.family, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM (VALUES ('Open'), ('Filled'), ('Pending'), ('None')) f(family) LEFT JOIN (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Pending' END AS family FROM orders) o USING (family) GROUP BY 1")
def family_style(spark, d):
    families = spark.createDataFrame([("O", "Open"), ("F", "Filled"), ("P", "Pending")], "o_orderstatus string, family string")
    mapped = table(spark, d, "orders").join(F.broadcast(families), "o_orderstatus")  # statuses without a family are dropped
    return rel.crosstab(mapped, "family", "o_orderpriority", ["Open", "Filled", "Pending", "None"], PRIORITIES)


@query("chorus_buckets", "SELECT least(n, 9)::INTEGER AS bucket, count(*) AS orders FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def chorus_buckets(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.least("n", F.lit(9)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("orders"))


DURATION = """
WITH b AS (SELECT l_quantity / nullif(round(l_tax * 100), 0) AS beats FROM lineitem),
s AS (SELECT count(beats) AS total, count(*) FILTER (beats > 0 AND beats <= 8) AS shown FROM b)
SELECT least(floor(beats / 0.25::DOUBLE), 31)::INTEGER AS bin, count(*) AS n, any_value(round(CASE WHEN total = 0 THEN 0 ELSE (total - shown) * 100.0::DOUBLE / total END, 6)) AS percent_outside
FROM b, s WHERE beats > 0 AND beats <= 8 GROUP BY 1"""


@query("duration_hist_clipped", DURATION)
def duration_histogram(spark, d):
    rows = table(spark, d, "lineitem").select(music.beats(F.col("l_quantity"), F.round(F.col("l_tax") * 100)).alias("beats"))
    inside = (F.col("beats") > 0) & (F.col("beats") <= 8)
    sizes = rows.agg(F.count("beats").alias("total"), F.count_if(inside).alias("shown"))
    shown = rows.where(inside).groupBy(F.least(F.floor(F.col("beats") / 0.25), F.lit(31)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return shown.join(F.broadcast(sizes)).select("bin", "n", F.round(music.percent_outside(F.col("total"), F.col("shown")), 6).alias("percent_outside"))


@query("equal_width_histogram", "WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT least(floor((o_totalprice - a) / ((b - a) / 40)), 39)::INTEGER AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def equal_width(spark, d):
    return rel.histogram(table(spark, d, "orders"), "o_totalprice", 40)


@query("annotated_stats", "SELECT l_returnflag AS model, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(sum(l_quantity) / count(*), 6) AS mean, round(quantile_cont(l_quantity, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def annotated(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"))
    return rows.agg(F.round(F.percentile("l_quantity", 0.5), 6).alias("median"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.percentile("l_quantity", 0.95), 6).alias("p95"))


@query("turn_gaps", "SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, conv_id, turn FROM conversations")
def turn_gaps(spark, d):
    line = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("role", F.lead("role").over(line).alias("next_role"), "conv_id", "turn")


SETS = """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM r)) AS both_sides, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM r)) AS either, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM r)) AS only_a"""


@query("set_operations", SETS)
def sets(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    keys = rows.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    # One aggregation serves the intersection, the union and the difference.
    return keys.agg(F.count_if(F.col("a") & F.col("r")).alias("both_sides"), F.count(F.lit(1)).alias("either"), F.count_if(F.col("a") & ~F.col("r")).alias("only_a"))
