"""Tables, logs, manifests, tasks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MELODY = ["melid", "eventid", "onset", "pitch", "duration", "bar", "beat", "beatdur"]
BEATS = ["melid", "beatid", "bar", "beat", "chord"]
TASK = "task_id string, input string, output_dir string, output_stem string, seed int, input_bars int, output_bars int"
RESULT = "task_id string, ok boolean, files array<string>, error string, duration_sec double"
SAMPLE = "struct<ok:boolean,duration_sec:double,error:string,ts:string>"
MANIFEST = (
    "schema_version int, slug string, config_hash string, themes map<string, struct<status:string,removed_from_corpus:boolean,excluded_due_to:string,"
    f"models:map<string, struct<status:string,samples:map<string,{SAMPLE}>>>>>"
)


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, or only some of its columns; a missing path is Spark's own error."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_database(spark: SparkSession, url: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a database by JDBC (the driver's jar is the cluster's to provide)."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table).load()
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; empty cells are null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", multiLine=True, escape='"')


def number(text: Column) -> Column:
    """A number from text; empty or other text is null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of tasks: blank lines are skipped, a bad or incomplete line is an error that shows it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", TASK).alias("t"))
    bad = F.col("t").isNull() | F.col("t.task_id").isNull() | F.col("t.input").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a task: "), F.col("value"))).cast("string")).otherwise(F.col("t.task_id"))
    return parsed.withColumn("_id", checked).where("_id is not null").select("t.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of results with ``line_no``, their place by file, part of the file and line; the last of a task counts.

    A part of a file is read by one task from its start to its end, so places order lines as the files do.
    """
    rows = spark.read.schema(RESULT).json(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("line_no", place)


def read_vocabulary(spark: SparkSession, path: str, divisions: int = 96) -> DataFrame:
    """(num, den, ticks): note lengths of a JSON file of pairs, as fractions of a whole note and in ticks of it."""
    body = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<int>>")).alias("p"))
    return body.select(F.col("p")[0].alias("num"), F.col("p")[1].alias("den"), (F.col("p")[0] * divisions / F.col("p")[1]).alias("ticks"))


def materialised(df: DataFrame, path: str) -> DataFrame:
    """A table that is written once and read from then on; a run that ended before its end is written again."""
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"), "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str, models: list[str]) -> tuple[DataFrame, DataFrame]:
    """(themes, samples) of a manifest; unknown models are dropped and missing fields have defaults."""
    held = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("themes").alias("theme", "t"))
    themes = held.select("theme", F.col("t.status").alias("status"), F.coalesce("t.removed_from_corpus", F.lit(False)).alias("removed"))
    samples = held.select("theme", F.explode("t.models").alias("model", "m")).where(F.col("model").isin(*models))
    samples = samples.select("theme", "model", F.explode("m.samples").alias("sample", "s"))
    return themes, samples.select("theme", "model", F.col("sample").cast("int").alias("sample_idx"), F.coalesce("s.ok", F.lit(False)).alias("ok"), "s.duration_sec", "s.error", "s.ts")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(name, bucket) of a split file with lists train, eval and test."""
    held = spark.read.schema("train array<string>, eval array<string>, test array<string>").json(path, multiLine=True)
    return held.unpivot([], ["train", "eval", "test"], "bucket", "names").select(F.explode("names").alias("name"), "bucket")


def loss_curve(lines: DataFrame, by: list[str], order: str, header: str, value: str) -> DataFrame:
    """(by, epoch, value) of a log: each value takes the last header before it, which serves once."""
    epoch, found = F.regexp_extract("line", header, 1).try_cast("int"), F.regexp_extract("line", value, 1).try_cast("double")
    line = Window.partitionBy(*by).orderBy(order)
    seen = lines.select(*by, order, epoch.alias("_e"), found.alias("_v"))
    seen = seen.withColumn("_at", F.sum(F.when(F.col("_e").isNotNull(), 1).otherwise(0)).over(line))
    seen = seen.withColumn("epoch", F.last("_e", ignorenulls=True).over(line)).where("_v is not null and epoch is not null")
    first = F.row_number().over(Window.partitionBy(*by, "_at").orderBy(order))
    return seen.withColumn("_n", first).where("_n = 1").select(*by, "epoch", F.col("_v").alias("value"))


def curve_summary(curve: DataFrame, by: list[str]) -> DataFrame:
    """The best epoch (the first of equals), the last value, and the gap between them in percent.

    In percent of a best value of zero, a gap is infinite and no gap is no number.
    """
    got = curve.groupBy(*by).agg(F.min("value").alias("best"), F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"), F.max_by("value", "epoch").alias("final"))
    got = got.withColumn("gap", F.col("final") - F.col("best"))
    of_zero = F.when(F.col("gap") > 0, F.lit(float("inf"))).when(F.col("gap") == 0, F.lit(float("nan")))
    return got.withColumn("gap_percent", F.when(F.col("best") == 0, of_zero).otherwise(F.try_divide(F.col("gap") * 100, F.col("best"))))
