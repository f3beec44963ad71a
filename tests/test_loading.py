"""Loading with skip policies, checks, studies, configurations and served rows."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from segno.operators import checks, domain, loading, sampling, studies
from segno.sources import config, tables
from segno.sources.served import DIED, served
from segno.streaming import streams

PARSED = "name string, seq_no int, pitch int, error string"


def parsed(spark):
    rows = [("a", 1, 64, None), ("a", 0, 60, None), ("b", 0, 60, None), ("c", None, None, "ValueError: no score"), ("x", 0, 1, None)]
    return spark.createDataFrame([(n,) for n in "abcd"], "name string"), spark.createDataFrame(rows, PARSED)


def test_every_wanted_piece_has_a_status(spark):
    got = {r["name"]: (r["status"], r["pitches"]) for r in loading.piece_status(*parsed(spark)).collect()}
    assert got == {"a": ("ok", [60, 64]), "b": ("too_short", None), "c": ("parse_error", None), "d": ("missing", None)}


def test_generated_pieces_that_fail_keep_an_empty_list(spark):
    got = {r["name"]: r["intervals"] for r in loading.generated_intervals(*parsed(spark)).collect()}
    assert got == {"a": [4], "b": [], "c": [], "d": []}


def test_generated_files_and_names(spark):
    stems = ["t1/alto/sample_0/gen_chunk_3.mid", "t1/alto/sample_2/gen_chunk_0.mid", "t2/alto/sample_0/gen_chunk_0.mid", "t1/alto/sample_0/gen_full.mid"]
    paths = spark.createDataFrame([(f"/run/themes/{s}",) for s in stems], "path string")
    got = loading.generated_files(paths, spark.createDataFrame([("t1",)], "theme string"), 2).collect()
    assert [(r["theme"], r["sample_idx"], r["chunk_idx"]) for r in got] == [("t1", 0, 3)]
    assert [r["name"] for r in loading.names(paths).collect()] == ["sample_0", "sample_2"]
    assert [r["path"] for r in loading.listing(paths, 1).collect()] == [f"/run/themes/{stems[0]}"]
    assert loading.listing(paths).count() == 4


def test_bad_candidates_are_replaced_and_too_few_are_an_error(spark):
    rows = spark.range(30).withColumnRenamed("id", "k")
    order = [r["k"] for r in rows.withColumn("d", sampling.draw_key(5, F.col("k"))).orderBy("d").collect()]
    got = [r["k"] for r in loading.valid_candidates(rows, "k", 4, F.col("k") % 2 == 0, 5).collect()]
    assert sorted(got) == sorted([k for k in order[:12] if k % 2 == 0][:4])
    with pytest.raises(Exception, match="fewer than 4 valid"):
        loading.valid_candidates(rows, "k", 4, F.col("k") < 1, 5).collect()


TASK = "task_id string, rule string, input_bars int, output_bars int, num_bars int, measures int, ts_num int, ts_den int"


@pytest.mark.parametrize(("task", "broken"), [
    (("mirror", 8, 8, 16, 8, 4, 4), []), (("mirror", 8, 8, 16, 8, None, None), []), (("mirror", 8, 4, 16, 8, 4, 4), ["output_bars must be half of num_bars", "output_bars must equal input_bars"]),
    (("multiple", 4, 12, None, 4, 4, 4), []), (("multiple", 4, 10, None, 4, 4, 4), ["output_bars must be a multiple of input_bars"]), (("multiple", 0, 4, None, 4, 4, 4), ["input_bars must be positive"]),
    (("free", 4, 3, None, 3, 3, 4), ["fewer measures than input_bars", "meter must be 4/4"]),
])
def test_task_rules(spark, task, broken):
    got = checks.task_violations(spark.createDataFrame([("t", *task)], TASK)).collect()
    assert sorted(r["violation"] for r in got) == broken


def test_resume_only_with_the_same_configuration():
    checks.guard_resume(None, "b")
    checks.guard_resume("b", "b")
    with pytest.raises(ValueError, match="began with configuration a"):
        checks.guard_resume("a", "b")


def test_configuration_reports_all_that_is_wrong(tmp_path):
    schema = {"slug": config.text, "samples": config.whole, "device": config.matching(r"cpu|cuda(:\d+)?"), "limit": config.whole_or("all"), "formats": config.choices(["mid", "xml"]), "model": {"heat": config.positive, "root": config.existing(str(tmp_path))}}
    good = {"slug": "run", "samples": 2, "device": "cuda:0", "limit": "all", "formats": ["mid"], "model": {"heat": 0.5, "root": "."}}
    assert config.problems(good, schema) == []
    bad = {"slug": "run", "samples": True, "device": "tpu", "limit": 0, "formats": ["mid", "mid"], "model": {"heat": 0, "root": "none"}, "more": 1}
    assert [f for f, _ in config.problems(bad, schema)] == ["more", "samples", "device", "limit", "formats", "model.heat", "model.root"]
    assert config.problems({**good, "model": 3}, schema) == [("model", "must be a mapping")]
    (tmp_path / "run.json").write_text(json.dumps(good))
    assert config.checked(str(tmp_path / "run.json"), schema) == good
    (tmp_path / "other.json").write_text(json.dumps(good))
    with pytest.raises(ValueError, match="slug: must be other"):
        config.checked(str(tmp_path / "other.json"), schema)
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(ValueError, match="not a mapping"):
        config.read_config(str(tmp_path / "list.json"))


SERVER = "import sys, json\nc = json.loads(input())\nfor line in sys.stdin:\n    r = json.loads(line)\n    if r['n'] == 3: sys.exit(1)\n    print(json.dumps({'ok': True, 'n': r['n'] * c['by']}), flush=True)"


def test_served_rows_and_a_program_that_dies(spark):
    tasks = spark.createDataFrame([(f"t{n}", json.dumps({"n": n})) for n in range(1, 5)], "task_id string, request string").coalesce(1).sortWithinPartitions("task_id")
    got = {r["task_id"]: (r["ok"], json.loads(r["body"]).get("n"), r["error"]) for r in served(tasks, [sys.executable, "-c", SERVER], {"by": 10}).collect()}
    assert got == {"t1": (True, 10, None), "t2": (True, 20, None), "t3": (False, None, DIED), "t4": (False, None, DIED)}


def test_results_keep_the_order_of_their_lines(spark, tmp_path):
    for name, oks in (("a.jsonl", [False, True]), ("b.jsonl", [True, False])):
        (tmp_path / name).write_text("".join(json.dumps({"task_id": name, "ok": ok, "error": str(k)}) + "\n" for k, ok in enumerate(oks)))
    last = tables.read_results(spark, str(tmp_path)).groupBy("task_id").agg(F.max_by("ok", "line_no").alias("ok")).collect()
    assert {r["task_id"]: r["ok"] for r in last} == {"a.jsonl": True, "b.jsonl": False}


def test_vocabulary_and_materialised_table(spark, tmp_path):
    (tmp_path / "v.json").write_text("[[1, 4], [1, 12]]")
    assert [tuple(r) for r in tables.read_vocabulary(spark, str(tmp_path / "v.json")).collect()] == [(1, 4, 24.0), (1, 12, 8.0)]
    path = str(tmp_path / "held")
    assert tables.materialised(spark.range(3), path).count() == 3
    assert tables.materialised(spark.range(5), path).count() == 3


def test_halves_are_even_and_seeded(spark):
    got = sampling.halves(spark.range(11), "id", [1, 2]).groupBy("trial", "half").count().collect()
    assert {(r["trial"], r["half"]): r["count"] for r in got} == {(1, "a"): 5, (1, "b"): 6, (2, "a"): 5, (2, "b"): 6}


def test_bias_of_a_selection(spark):
    rng = random.Random(4)
    rows = lambda m: [("f", k, [rng.gauss(m, 1)]) for k in range(30)]
    real = spark.createDataFrame(rows(0), "feature string, id long, vec array<double>")
    made = spark.createDataFrame([(*r, "near") for r in rows(0)] + [(*r, "far") for r in rows(40)], "feature string, id long, vec array<double>, model string")
    got = {(r["trial"], r["model"]): r["oa"] for r in studies.bias(real, made, ["feature"], 15, [1]).collect()}
    assert got[1, "near"] > 0.6 and got[1, "far"] < 0.05


@pytest.mark.parametrize(("offsets", "grid"), [([0.0, 0.33, 0.67], 3), ([0.0, 0.25, 0.5, 0.75], 4), ([0.02], 4)])
def test_each_quarter_has_its_own_grid(spark, offsets, grid):
    rows = spark.createDataFrame([("p", 4 + x) for x in offsets], "piece string, offset_q double")
    got = domain.quarter_snapped(rows, ["piece"]).collect()
    assert {r["grid"] for r in got} == {grid}
    assert all(abs(r["snapped_q"] * grid - round(r["snapped_q"] * grid)) < 1e-9 for r in got)


def test_notes_are_tied_over_barlines(spark):
    rows = spark.createDataFrame([(0, 3.0, 6.0), (1, 0.0, 4.0)], "seq_no int, offset_q double, length_q double")
    got = [(r["seq_no"], r["measure_no"], r["offset_in_measure_q"], r["length_q"], r["tie"]) for r in domain.melody_measures(rows).orderBy("seq_no", "measure_no").collect()]
    assert got == [(0, 1, 3.0, 1.0, "start"), (0, 2, 0.0, 4.0, "continue"), (0, 3, 0.0, 1.0, "stop"), (1, 1, 0.0, 4.0, None)]


def test_streamed_counts_go_on_from_their_state(spark, tmp_path):
    schema = "ts timestamp, event_type string"

    def land(name, rows):
        spark.createDataFrame(rows, "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        held = streams.upsert_counts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return {(str(r["window_start"]), r["event_type"]): r["n"] for r in held.collect()}

    land("one", [("2024-01-01 00:05:00", "a"), ("2024-01-01 00:50:00", "a")])
    assert run() == {("2024-01-01 00:00:00", "a"): 2}
    land("two", [("2024-01-01 00:55:00", "a"), ("2024-01-01 05:00:00", "b")])
    assert run() == {("2024-01-01 00:00:00", "a"): 3, ("2024-01-01 05:00:00", "b"): 1}
