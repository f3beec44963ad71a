"""Readers and writers, on files of their own."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from segno.sources import scores, sinks, tables
from segno.streaming import streams


def test_midi_round_trip(spark, tmp_path):
    held = [{"pitch": 60, "velocity": 80, "start_s": 0.0, "end_s": 0.5}, {"pitch": 64, "velocity": 70, "start_s": 0.5, "end_s": 1.25}]
    (tmp_path / "a.mid").write_bytes(scores.midi(held, 120))
    (tmp_path / "b.mid").write_bytes(b"no midi")
    got = scores.read_midi(spark, str(tmp_path)).orderBy("path", "start_s").collect()
    assert [(r["pitch"], round(r["start_s"], 3), round(r["end_s"], 3)) for r in got[:2]] == [(60, 0.0, 0.5), (64, 0.5, 1.25)]
    assert got[2]["error"].startswith("ValueError")


def test_musicxml_round_trip_splits_at_barlines(spark, tmp_path):
    text = scores.musicxml([{"offset_q": 0.0, "length_q": 1.0, "pitch": 60}, {"offset_q": 3.0, "length_q": 2.0, "pitch": 66}], [{"offset_q": 0.0, "root_pc": 1, "kind": "minor"}])
    (tmp_path / "a.musicxml").write_text(text)
    (tmp_path / "bad.musicxml").write_text("<score")
    got = scores.read_musicxml(spark, str(tmp_path)).cache()
    held = got.where("kind = 'note'").orderBy("offset_q").collect()
    assert [(r["offset_q"], r["length_q"], r["pitch"], r["tie"]) for r in held] == [(0.0, 1.0, 60, None), (3.0, 1.0, 66, "start"), (4.0, 1.0, 66, "stop")]
    assert got.where("kind = 'chord'").first()["root_pc"] == 1
    assert got.where("error is not null").count() == 1


def test_backup_and_pickup():
    xml = b"""<score-partwise><part id="P1"><measure number="0"><attributes><divisions>2</divisions></attributes>
    <note><pitch><step>C</step><octave>5</octave></pitch><duration>2</duration></note></measure>
    <measure number="1"><note><pitch><step>D</step><octave>5</octave></pitch><duration>8</duration></note><backup><duration>4</duration></backup>
    <note><chord/><pitch><step>F</step><alter>1</alter><octave>5</octave></pitch><duration>4</duration></note></measure></part></score-partwise>"""
    held = [(e["offset_q"], e["pitch"]) for e in scores.parse_musicxml(xml) if e["kind"] == "note"]
    assert held == [(0.0, 72), (1.0, 74), (1.0, 78)]


def test_paths(spark):
    df = spark.createDataFrame([("/x/themes/728_I/alto/sample_1/gen_chunk_10.mid",), ("/x/themes/a/alto/sample_x/y.mid",)], "path string")
    got = scores.file_parts(df).collect()
    assert (got[0]["theme"], got[0]["model"], got[0]["sample_idx"], got[0]["chunk_idx"]) == ("728_I", "alto", 1, 10)
    assert got[1]["sample_idx"] is None


def test_csv_and_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, x double")
    sinks.write_csv(df, str(tmp_path / "out.csv"), ["k"])
    sinks.write_csv(df, str(tmp_path / "out.csv"), ["k"])  # replaces
    got = tables.read_csv(spark, str(tmp_path / "out.csv"), "k string, x string").select("k", tables.number(F.col("x")).alias("x")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 0.5), ("b", None)]


def test_manifest_and_split(spark, tmp_path):
    themes = spark.createDataFrame([("t", "ok", False)], "theme string, status string, removed boolean")
    samples = spark.createDataFrame([("t", "alto", 0, True, 1.0, None, "2024")], "theme string, model string, sample_idx int, ok boolean, duration_sec double, error string, ts string")
    path = str(tmp_path / "manifest.json")
    sinks.write_manifest(themes, samples, path, slug="s")
    _, got = tables.read_manifest(spark, path, ["alto"])
    assert got.first()["ok"] is True
    sinks.write_split(spark.createDataFrame([("a", "train"), ("b", "test")], "name string, bucket string"), str(tmp_path / "split.json"))
    assert json.loads((tmp_path / "split.json").read_text()) == {"train": ["a"], "eval": [], "test": ["b"]}
    assert tables.read_split(spark, str(tmp_path / "split.json")).count() == 2


def test_tasks_must_be_whole(spark, tmp_path):
    import pytest

    (tmp_path / "t.jsonl").write_text('{"task_id": "a/0", "input": "x"}\n\n')
    assert tables.read_tasks(spark, str(tmp_path / "t.jsonl")).count() == 1
    (tmp_path / "u.jsonl").write_text('{"task_id": "a/0"}\n')
    with pytest.raises(Exception, match="not a task"):
        tables.read_tasks(spark, str(tmp_path / "u.jsonl")).collect()


def test_loss_curve(spark):
    lines = ["Epoch 1/9", "nll/eval: 0.5", "nll/eval: 0.4", "Epoch 2/9", "x", "nll/eval: 0.3", "Epoch 3/9"]
    df = spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)], "run string, line_no int, line string")
    got = tables.loss_curve(df, ["run"], "line_no", r"^Epoch (\d+)", r"^nll/eval: ([\d.]+)").orderBy("epoch").collect()
    assert [(r["epoch"], r["value"]) for r in got] == [(1, 0.5), (2, 0.3)]


def test_config_digest_ignores_order():
    assert sinks.config_digest({"a": 1, "b": [2]}) == sinks.config_digest({"b": [2], "a": 1})


def test_encoded_scores(spark):
    df = spark.createDataFrame([("p", 0, 60, 80, 0.0, 0.5)], "piece string, seq_no int, pitch int, velocity int, start_s double, end_s double")
    content = bytes(sinks.encoded_scores(df, ["piece"]).first()["content"])
    assert next(iter(scores.parse_midi(content)))["pitch"] == 60


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(3).write.parquet(str(source / "a"))
    stream = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", "true").parquet(str(source))
    for _ in range(2):
        streams.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    spark.range(2).write.parquet(str(source / "b"))
    streams.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_compressed_scores(spark, tmp_path):
    text = scores.musicxml([{"offset_q": 0.5, "length_q": 4.0, "pitch": 61}], [{"offset_q": 0.0, "root_pc": 1, "kind": "minor"}])
    packed = scores.packed_musicxml(text)
    assert list(scores.parse_musicxml(packed)) == list(scores.parse_musicxml(text.encode())) and packed == scores.packed_musicxml(text) and len(packed) < len(text)
    broken = packed.replace(b"META-INF/container.xml", b"META-INF/containes.xml")
    (tmp_path / "a.mxl").write_bytes(packed)
    (tmp_path / "b.mxl").write_bytes(broken)
    got = {r["path"][-5:]: r["error"] for r in scores.read_musicxml(spark, str(tmp_path), "*.mxl").select("path", "error").distinct().collect()}
    assert got["a.mxl"] is None and "container" in got["b.mxl"]


def test_a_task_holds_one_piece_and_few_files(monkeypatch):
    """Pieces of one batch are made one by one, and handed on before all are made."""
    monkeypatch.setattr(sinks, "WRITTEN_BYTES", 20)
    batch = pa.RecordBatch.from_pydict({"piece": list(range(30)), "notes": [[{"pitch": p}] for p in range(30)]})
    made: list[int] = []

    def make(notes: list[dict]) -> bytes:
        made.append(notes[0]["pitch"])
        return b"%04d" % notes[0]["pitch"]

    found = sinks.made_files(iter([batch]), ["piece"], ["notes"], make)
    first = next(found)
    assert len(made) == first.num_rows == 5
    rows = [r for b in (first, *found) for r in b.to_pylist()]
    assert rows == [{"piece": p, "content": b"%04d" % p} for p in range(30)]


def test_pieces_go_to_the_workers_one_at_a_time(spark):
    """Notes are gathered neither in the plan nor by the batch; a piece that comes in several batches is one file."""
    rows = [(p, k, 40 + k, 80, k * 0.5, k * 0.5 + 0.5) for p in ("a", "b", None) for k in range(7)]
    df = spark.createDataFrame(rows[::-1], "piece string, seq_no int, pitch int, velocity int, start_s double, end_s double")
    made = sinks.encoded_scores(df, ["piece"])
    assert "collect_list" not in made._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {r["piece"]: [n["pitch"] for n in scores.parse_midi(bytes(r["content"]))] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {p: list(range(40, 47)) for p in ("a", "b", None)}


def test_notes_of_pieces_are_shuffled_once(spark, tmp_path):
    from segno.plans.bindings import PIECE, piece_notes

    row = (1, 1, 1, 1, 5.0, 9.5, 0.02, "R")
    spark.createDataFrame([row], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = sinks.encoded_scores(piece_notes(spark, str(tmp_path)), PIECE)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
