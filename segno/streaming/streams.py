"""Streaming forms: counts in windows, deduplication, tie chains that stay open, and results that arrive bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from segno.shipping import ship_package


def tumbling_counts(events: DataFrame, at: str = "ts", by: str = "event_type", window: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events in each window and group; late ones within the watermark count. Batch or stream alike."""
    events = events.withWatermark(at, late) if late and events.isStreaming else events
    return events.groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def without_repeats(events: DataFrame, keys: list[str], at: str = "ts", late: str | None = "10 minutes") -> DataFrame:
    """The first event of each key; a stream forgets keys behind the watermark, or none without one."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if late and events.isStreaming else events.dropDuplicates(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what has arrived, exactly once, and stop; the next run goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_counts(events: DataFrame, path: str, checkpoint: str, **window) -> DataFrame:
    """Windowed counts of a stream, kept up to date as it arrives: (window_start, by, n) after one available-now run.

    Counts live in the stream's state until the watermark passes. Each batch lays down the counts that
    it changed in a folder of its own number, so a batch that runs twice writes the same; the last
    batch of a window and group holds.
    """
    counts = tumbling_counts(events, **window)
    sink = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/run={number}")
    counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = events.sparkSession.read.parquet(path)
    keys = [c for c in counts.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def append_results(results: DataFrame, sink, checkpoint: str) -> None:
    """Hand each batch of new results to ``sink(df, number)``, which may upsert them."""
    results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tie_chains(notes: DataFrame, by: list[str], order: str, quiet: str | None = None) -> DataFrame:
    """(by, chain, n, ticks, open): the tie chains of a stream of notes, told whenever a batch changes them.

    ``notes`` has ``by``, ``order``, tie and ticks; a piece's notes come in order from batch to batch, in any
    order within one. The state of a piece is its open chain: number, notes, length, and whether a tie may go
    on. A start opens one; continue and stop go on if one is open. With ``quiet`` the state of a piece that had no
    notes for so long (processing time, as "1 hour") goes, and a later note begins at chain 1 again.
    """
    ship_package(notes.sparkSession)
    wait = None if quiet is None else int(pd.Timedelta(quiet).total_seconds() * 1000)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.select(*by).schema)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        chain, n, ticks, may = state.get if state.exists else (0, 0, 0, False)
        rows = pd.concat(batches).sort_values(order, kind="stable")
        out = []
        for tie, length in zip(rows["tie"], rows["ticks"], strict=True):
            if may and tie in ("continue", "stop"):
                n, ticks = n + 1, ticks + int(length)
            else:
                if n:
                    out.append((chain, n, ticks, False))
                chain, n, ticks = chain + 1, 1, int(length)
            may = tie == "start" or (may and isinstance(tie, str))
        out.append((chain, n, ticks, True))
        state.update((chain, n, ticks, bool(may)))
        if wait is not None:
            state.setTimeoutDuration(wait)
        told = pd.DataFrame(out, columns=["chain", "n", "ticks", "open"])
        for place, name in enumerate(by):
            told.insert(place, name, key[place])
        yield told

    timer = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return notes.select(*by, order, "tie", "ticks").groupBy(*by).applyInPandasWithState(step, f"{kinds}, chain long, n long, ticks long, open boolean", "chain long, n long, ticks long, may boolean", "update", timer)


def changed_chains(notes: DataFrame, held: DataFrame | None, by: list[str], order: str) -> DataFrame:
    """(by, chain, n, ticks, open, may, told): the chains of a batch of notes and of ``held``, the open chains before it.

    As ``tie_chains``, by windows over each piece. ``held`` has (by, chain, n, ticks, may), or is None. A piece without notes in
    the batch keeps its open chain, untold.
    """
    mark = F.when(F.col("tie") == "start", True).when(F.col("tie").isNull(), False)
    rows = notes.select(*by, F.lit(1).alias("_at"), F.col(order).alias("_order"), F.col("tie").alias("_tie"), mark.alias("_mark"), F.lit(1).cast("long").alias("n"), F.col("ticks").cast("long").alias("ticks"), F.lit(None).cast("long").alias("_from"))
    if held is not None:
        none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
        rows = rows.unionByName(held.select(*by, F.lit(0).alias("_at"), none("_order"), none("_tie"), F.col("may").alias("_mark"), "n", "ticks", F.col("chain").alias("_from")))
    group = Window.partitionBy(*by)
    line = group.orderBy("_at", "_order")
    last = lambda end: F.coalesce(F.last("_mark", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, end)), F.lit(False))
    rows = rows.withColumn("_before", last(-1)).withColumn("may", last(0))
    goes_on = F.col("_before") & F.coalesce(F.col("_tie").isin("continue", "stop"), F.lit(False))
    begun = F.coalesce("_from", F.when(goes_on, 0).otherwise(1).cast("long"))
    rows = rows.withColumn("chain", F.sum(begun).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*by, "chain").agg(F.sum("n").alias("n"), F.sum("ticks").alias("ticks"), F.max_by("may", F.struct("_at", "_order")).alias("may"), F.max("_at").alias("_at"))
    return out.select(*by, "chain", "n", "ticks", (F.col("chain") == F.max("chain").over(group)).alias("open"), "may", (F.max("_at").over(group) == 1).alias("told"))


def upsert_chains(notes: DataFrame, by: list[str], order: str, path: str, checkpoint: str) -> None:
    """Lay down the chains that each batch of a stream changed, in a folder of its own number, and stop when what arrived is read.

    The next call goes on from the checkpoint, with the chains that were open. These are a table beside the checkpoint,
    one for each batch, of which the last two stay; a batch that runs twice reads the same and writes the same.
    """
    spark = notes.sparkSession
    state = f"{checkpoint.rstrip('/')}-chains"

    def step(batch: DataFrame, number: int) -> None:
        held = spark.read.parquet(f"{state}/run={number - 1}").where("open") if number else None
        changed_chains(batch, held, by, order).write.mode("overwrite").parquet(f"{state}/run={number}")
        told = spark.read.parquet(f"{state}/run={number}").where("told").drop("may", "told")
        told.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/run={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/run={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    rows = notes.select(*by, order, "tie", "ticks")
    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_chains(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(by, chain, n, ticks): every chain as the last batch that changed it told it."""
    rows = spark.read.parquet(path).groupBy(*by, "chain").agg(F.max_by(F.struct("n", "ticks"), "batch").alias("x"))
    return rows.select(*by, "chain", "x.n", "x.ticks")
