"""Writers: tables as one CSV file, JSON lines, manifests, splits and score files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from segno.functions import music
from segno.operators.checks import guard_resume
from segno.shipping import ship_package

#: Bytes of score files that a task hands on at once.
WRITTEN_BYTES = 4 << 20


def six_places(df: DataFrame) -> DataFrame:
    """Floating columns as text with six places; null as empty text."""
    text = lambda c: F.when(F.col(c).isNull(), "").otherwise(music.places(F.col(c).cast("double"), 6))
    return df.select(*[text(c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, quote_all: bool = False, whole: bool = True, rounded: bool = True) -> None:
    """A CSV in a folder that appears whole: written aside by Spark, then renamed.

    ``whole`` puts a small report into one file; a large table is written in parts. Numbers have six places
    unless ``rounded`` is false.
    """
    out = six_places(df) if rounded else df
    out = out.orderBy(*order) if order and whole else out
    out = out.coalesce(1) if whole else out
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    out.write.csv(aside, header=True, quoteAll=quote_all, emptyValue="", nullValue="", escape='"')
    jvm = df.sparkSession.sparkContext._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
    fs = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{aside} could not be renamed to {path}")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; an existing output is an error unless asked otherwise."""
    df.write.mode(mode).json(path)


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)


def manifest_rows(themes: DataFrame, samples: DataFrame) -> DataFrame:
    """(theme, json): the nested state of each theme."""
    one = F.struct("ok", "duration_sec", "error", "ts")
    by_model = samples.groupBy("theme", "model").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sample_idx").cast("string"), one))).alias("samples"))
    by_theme = by_model.groupBy("theme").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("samples")))).alias("models"))
    out = themes.join(by_theme, "theme", "left")
    return out.select("theme", F.to_json(F.struct("status", F.col("removed").alias("removed_from_corpus"), "models")).alias("json"))


def write_manifest(themes: DataFrame, samples: DataFrame, path: str, **head) -> None:
    """One JSON file of the run's state, replaced whole. A manifest is read by its runner, so it is small."""
    body = {r["theme"]: json.loads(r["json"]) for r in manifest_rows(themes, samples).toLocalIterator()}
    replace(themes.sparkSession, path, json.dumps(head | {"themes": body}, indent=2, ensure_ascii=False))


def write_split(split: DataFrame, path: str) -> None:
    rows = split.groupBy("bucket").agg(F.sort_array(F.collect_list("name")).alias("names")).collect()
    names = {r["bucket"]: r["names"] for r in rows}
    replace(split.sparkSession, path, json.dumps({b: names.get(b, []) for b in ("train", "eval", "test")}, indent=2, ensure_ascii=False))


def replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark writes to: written aside, then renamed."""
    jvm = spark.sparkContext._jvm
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{aside} could not be renamed to {path}")


def config_snapshot(spark: SparkSession, config: dict, folder: str) -> str:
    """Lay down the configuration of a run beside its results, or refuse to go on with another one; its digest.

    The digest that the folder holds is that of the run's first configuration.
    """
    digest = config_digest(config)
    name = f"{folder.rstrip('/')}/config_snapshot.json"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        held = json.loads(spark.read.text(name, wholetext=True).first()["value"])
        guard_resume(held["config_hash"], digest)
        return digest
    replace(spark, name, json.dumps({"config_hash": digest, "config": config}, indent=2, ensure_ascii=False, sort_keys=True))
    return digest


def set_aside(spark: SparkSession, paths: DataFrame, root: str, trash: str) -> DataFrame:
    """(path, moved): move files or folders (``path``, below ``root``) into ``trash``, under the same names, so that
    they can be taken back; one that is not there is not moved. The list is one that a user gives, so it is small."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for r in paths.select("path").distinct().toLocalIterator():
        source, target = (jvm.org.apache.hadoop.fs.Path(f"{x.rstrip('/')}/{r['path']}") for x in (root, trash))
        fs = source.getFileSystem(conf)
        moved = bool(fs.exists(source)) and not fs.exists(target)
        if moved:
            fs.mkdirs(target.getParent())
            moved = bool(fs.rename(source, target))
        out.append((r["path"], moved))
    return spark.createDataFrame(out, "path string, moved boolean")


def config_digest(config: dict) -> str:
    """A digest that neither key order nor layout changes."""
    return "sha256:" + hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def made_files(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str], make: Callable[..., bytes]) -> Iterator[pa.RecordBatch]:
    """(by, content): ``make`` of the arrays of each row. One row at a time is held as objects, and files are handed on
    when they have WRITTEN_BYTES."""
    for batch in batches:
        begun, content, size = 0, [], 0
        for k in range(batch.num_rows):
            content.append(make(*[batch.column(c)[k].as_py() for c in columns]))
            size += len(content[-1])
            if size >= WRITTEN_BYTES or k + 1 == batch.num_rows:
                names = [batch.column(c).slice(begun, len(content)) for c in by]
                yield pa.RecordBatch.from_arrays([*names, pa.array(content, pa.binary())], [*by, "content"])
                begun, content, size = k + 1, [], 0


def _contents(pieces: DataFrame, by: list[str], columns: list[str], make: Callable[..., bytes]) -> DataFrame:
    ship_package(pieces.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*by).schema)
    return pieces.select(*by, *columns).mapInArrow(lambda batches: made_files(batches, by, columns, make), f"{kinds}, content binary")


def encoded_scores(notes: DataFrame, by: list[str], form: str = "midi", bpm: float = 120.0) -> DataFrame:
    """(by, content): each piece's notes as a MIDI file or a MusicXML score, made on the executors.

    Pieces go to the workers one at a time, as rows, in parts; only the piece that is made is held whole.
    """
    ship_package(notes.sparkSession)
    fields = ["pitch", "velocity", "start_s", "end_s"] if form == "midi" else ["pitch", "offset_q", "length_q"]
    held = notes.select(*by, "seq_no", *fields)
    kinds = pa.schema([f for f in to_arrow_schema(held.schema) if f.name in by])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from segno.sources import scores

        piece = pa.Table.from_batches(list(batches))  # a piece's own notes
        piece = piece.take(pc.sort_indices(piece, [(c, "ascending") for c in ("seq_no", *fields)], null_placement="at_start"))
        rows = piece.select(fields).to_pylist()
        content = scores.midi(rows, bpm) if form == "midi" else scores.musicxml(rows, bpm=bpm).encode()
        names = [piece.column(c).slice(0, 1).combine_chunks().cast(kinds.field(c).type) for c in by]
        yield pa.RecordBatch.from_arrays([*names, pa.array([content], pa.binary())], [*by, "content"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.select(*by).schema)
    return held.groupBy(*by).applyInArrow(make, f"{names}, content binary")


def assembled_scores(pieces: DataFrame, by: list[str], bpm: float = 120.0, packed: bool = False) -> DataFrame:
    """(by, content): MusicXML of pieces with notes and chords as arrays (``assembly.with_chords``), made on the executors.

    ``packed`` gives compressed MusicXML, for names that end in .mxl.
    """

    def make(notes: list[dict], chords: list[dict]) -> bytes:
        from segno.sources import scores

        text = scores.musicxml(notes, chords, bpm)
        return scores.packed_musicxml(text) if packed else text.encode()

    return _contents(pieces, by, ["notes", "chords"], make)
