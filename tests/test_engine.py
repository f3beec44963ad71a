"""Operators that work in rounds, blocks, files and streams, against brute force on small inputs."""

import contextlib
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segno import shared
from segno.operators import assembly, copying, distances, divergence, domain, loading, metrics, phase, quantiles, relational, studies, suffixes
from segno.operators import segment_metrics as seg
from segno.sources import score_source, scores, sinks, sqlite_source
from segno.streaming import streams

# --- suffix order -------------------------------------------------------------------------------


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize(("symbols", "hot"), [(2, 1000), (12, 5), (40, 1000)])
def test_longest_common_runs_equal_brute_force(spark, symbols, hot, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    rng = random.Random(symbols)
    train = [[rng.randrange(symbols) for _ in range(rng.randrange(0, 60))] for _ in range(12)] + [[], [1] * 20]
    made = {}
    for k in range(25):
        own = [rng.randrange(symbols) for _ in range(rng.randrange(0, 40))]
        if k % 3 == 0:  # a piece that copies a stretch
            held = rng.choice(train)
            at = rng.randrange(len(held) + 1)
            own = own[:5] + held[at : at + rng.randrange(30)] + own[5:]
        made[("m" if k % 2 else "n", f"c{k}")] = own
    made[("n", "none")] = [999] * 9
    made[("n", "empty")] = []
    generated = spark.createDataFrame([(m, c, s) for (m, c), s in made.items()], "model string, chunk string, seq array<int>")
    known = spark.createDataFrame([(f"t{k}", s) for k, s in enumerate(train)], "piece string, seq array<int>")
    got = {(r["model"], r["chunk"]): r["lcs"] for r in suffixes.longest_common_runs(generated, known).collect()}
    assert got == {k: max(longest(s, t) for t in train) for k, s in made.items()}


def test_longest_common_runs_of_long_copies_and_of_nothing(spark):
    piece = [k * k % 251 for k in range(700)]
    generated = spark.createDataFrame([("m", "a", piece[100:600]), ("m", "b", piece)], "model string, chunk string, seq array<int>")
    known = spark.createDataFrame([("t", [7000, *piece])], "piece string, seq array<int>")
    assert {r["chunk"]: r["lcs"] for r in suffixes.longest_common_runs(generated, known).collect()} == {"a": longest(piece[100:600], piece), "b": 700}
    assert suffixes.longest_common_runs(generated, known.limit(0)).agg(F.sum("lcs")).first()[0] == 0
    assert suffixes.longest_common_runs(generated.limit(0), known).count() == 0


def test_plagiarism_names_what_is_empty(spark):
    train = spark.createDataFrame([("t", [1, 2, 3, 4, 5, 6])], "piece string, seq array<int>")
    made = spark.createDataFrame([("a", "x", [1, 2, 3, 4, 9, 9, 9]), ("a", "y", []), ("b", "x", [1, 2]), ("c", "x", [])], "model string, chunk string, seq array<int>")
    row = copying.plagiarism(made, train, ["a"]).first()
    assert (row["n_gen_chunks"], row["n_gen_chunks_lcs"], row["n_gen_ngrams_n3"], row["n_train_pieces"], row["lcs_max_max"]) == (2, 1, 5, 1, 4.0)
    assert row["ngram_overlap_n3"] == pytest.approx(2 / 5) and row["ngram_overlap_n5"] == 0.0
    for model, text in (("b", "no 3-grams of b"), ("c", "no generated piece with symbols of c"), ("d", "no generated pieces of d")):
        with pytest.raises(Exception, match=text):
            copying.plagiarism(made, train, [model]).collect()
    with pytest.raises(ValueError, match="training corpus is empty"):
        copying.plagiarism(made, train.limit(0), ["a"])


# --- ranks --------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["even", "skewed", "ties", "wide"])
def test_selected_quantiles_equal_sorted_ones(spark, kind):
    rng = random.Random(kind)
    draw = {"even": lambda: rng.random(), "skewed": lambda: math.exp(40 * rng.random()), "ties": lambda: float(rng.randrange(3)), "wide": lambda: rng.choice((-1e300, 1e300, 0.0, 1e-300, rng.random()))}[kind]
    rows = [(g, draw()) for g in "ab" for _ in range(700)] + [("few", 3.0), ("few", 4.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.quantiles(df, ["g"], shares, small=40, bins=8).collect()}
    for g in ("a", "b", "few", None):
        own = np.array([x for k, x in rows if k == g])
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(np.quantile(own, shares).tolist(), rel=1e-12)


def test_eight_numbers_leave_missing_values_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", 3.0), ("a", None), ("b", None), ("c", 5.0)], "g string, x double")
    got = {r["g"]: r for r in relational.eight_numbers(df, ["g"], "x").collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["median"], got["a"]["max"]) == (2, 2.0, 2.0, 3.0)
    assert (got["b"]["n"], got["b"]["mean"], got["b"]["median"]) == (0, None, None) and got["c"]["std"] is None


def test_running_totals_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), k, rng.randrange(5), 1) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v int, w int").repartition(7)
    got = shared.running_totals(df, ["g"], ["k"], ["v", "w"]).collect()
    assert len(got) == 400
    for r in got:
        before = [x for x in rows if x[0] == r["g"] and x[1] < r["k"]]
        assert (r["below_v"], r["below_w"]) == (sum(x[2] for x in before), len(before))


# --- distances and densities --------------------------------------------------------------------


def test_blocks_give_every_pair_once(spark):
    rng = random.Random(6)
    real = [("f", k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(41)] + [("g", k, [float(k)]) for k in range(3)]
    made = [("f", 100 + k, [rng.gauss(1, 1) for _ in range(3)], m) for m in "uv" for k in range(23)]
    df = spark.createDataFrame(real, "feature string, id long, vec array<double>"), spark.createDataFrame(made, "feature string, id long, vec array<double>, model string")
    found = distances.distance_samples(*df, ["feature"], block=10)
    got = {(r["feature"], r["model"], r["kind"]): r for r in distances.distance_summary(found, ["feature"]).collect()}
    own = [math.dist(a[2], b[2]) for a in real for b in real if a[0] == b[0] == "f" and a[1] != b[1]]
    to_u = [math.dist(a[2], b[2]) for a in real for b in made if a[0] == "f" and b[3] == "u"]
    for key, want in ((("f", None, "intra"), own), (("f", "u", "inter"), to_u)):
        r = got[key]
        assert r["n"] == len(want) and (r["low"], r["high"], r["mean"]) == pytest.approx((min(want), max(want), sum(want) / len(want)))
    assert got[("g", None, "intra")]["n"] == 6 and len(got) == 4


def test_close_vectors_are_measured_by_their_difference():
    a = np.array([[1e6, 1e6], [1e6 + 1e-3, 1e6]])
    assert distances.pairwise(a, a)[0, 1] == pytest.approx(1e-3, rel=1e-6) and distances.pairwise(a, a)[0, 0] == 0


def test_clusters_keep_weight_mean_and_spread():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(5, 1, 30_000), rng.exponential(3, 20_000)])
    w, mean, m2 = distances.clusters(x, 256)
    assert w.sum() == len(x) and (w * mean).sum() == pytest.approx(x.sum()) and (m2 + w * (mean - x.mean()) ** 2).sum() == pytest.approx(((x - x.mean()) ** 2).sum())


def test_binned_densities_stay_within_the_stated_error(spark):
    import pandas as pd

    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(2, 1, 60_000))
    w, mean, m2 = distances.clusters(x)
    rows = pd.DataFrame({"w": w, "x": mean, "d1": 0.0, "d2": m2, "low": x.min(), "high": x.max()})
    sample = divergence.Sample(rows)
    at = np.linspace(x.min(), x.max(), 41)
    exact = np.array([np.exp(-0.5 * ((a - x) / sample.h) ** 2).sum() for a in at]) / (len(x) * sample.h * math.sqrt(2 * math.pi))
    assert np.abs(sample.density(at) / exact - 1).max() < 1e-6


def test_an_empty_corpus_has_no_divergence(spark):
    real = spark.createDataFrame([("a",)], "pattern string")
    made = spark.createDataFrame([("m", "a")], "model string, pattern string")
    with pytest.raises(Exception, match="the real corpus is empty"):
        divergence.jensen_shannon(real.limit(0), made, "pattern").collect()


# --- plugged metrics, the phase, studies --------------------------------------------------------


def small_notes(spark):
    rows = [(1, "m", 0, 0, 0, k, 60 + p, 80, k * 0.5, k * 0.5 + 0.5) for k, p in enumerate((0, 4, 7, 1))]
    return spark.createDataFrame(rows, "theme long, model string, sample_idx int, chunk_idx int, instr int, seq_no int, pitch int, velocity int, start_s double, end_s double")


def test_a_metric_is_plugged_in(spark):
    notes = small_notes(spark)
    segments = spark.createDataFrame([(1, "m", 0, 0), (2, "m", 0, 0)], "theme long, model string, sample_idx int, chunk_idx int")
    chords = spark.createDataFrame([(1, 0, 0, 0.0, [0, 4, 7], [0, 2, 4, 5, 7, 9, 11])], "theme long, chunk_idx int, seq_no int, offset_q double, pcs array<int>, scale_pcs array<int>")
    melodies = spark.createDataFrame([(1, 0, [60, 64, 67, 61])], "theme long, chunk_idx int, melody array<int>")
    metrics.add_part("test_highest", lambda n: F.max(n.pitch))
    metrics.add(metrics.Metric("test_high", ("test_highest", "notes"), lambda p: p["test_highest"] / p["notes"], none=-1.0))
    try:
        rows = {r["theme"]: r for r in metrics.per_segment(segments, notes, chords, melodies, names=[*metrics.METRICS, "test_high"]).collect()}
        assert rows[1]["test_high"] == 16.75 and rows[2]["test_high"] == -1.0
        assert rows[1]["ctr"] == 0.75 and rows[1]["ngram_3_overlap"] == 1.0 and rows[1]["pitch_entropy"] == 2.0 and rows[1]["n_notes"] == 4
        assert rows[2]["ctr"] is None and rows[2]["note_density"] == 0.0 and rows[2]["n_notes"] == 0 and rows[2]["pitch_entropy"] is None
        with pytest.raises(ValueError, match="already"):
            metrics.add(metrics.Metric("test_high", ("notes",), lambda p: p["notes"]))
        with pytest.raises(ValueError, match="no_part"):
            metrics.add(metrics.Metric("test_other", ("no_part",), lambda p: p["no_part"]))
        old = seg.per_segment(segments, notes, chords, melodies).orderBy("theme").collect()
        assert [[r[m] for m in metrics.METRICS] for r in old] == [[rows[r["theme"]][m] for m in metrics.METRICS] for r in old]
    finally:
        metrics.REGISTRY.pop("test_high"), metrics.PARTS.pop("test_highest")


def test_the_phase_names_a_report_that_lacks_a_row(spark, tmp_path):
    held = spark.createDataFrame([(f"t{k}", m, 0, 0, 3, float(k)) for k in range(6) for m in "xy"], "theme string, model string, sample_idx int, chunk_idx int, n_notes long, ctr double")
    with pytest.raises(Exception, match="no row for"):
        phase.run(held, [], str(tmp_path / "run"), ["x", "y"], ["ctr"]).collect()
    assert {p for p in os.listdir(tmp_path / "run") if p.endswith(".csv")} == {"per_segment.csv", "aggregates.csv", "significance.csv"}
    lines = [p for p in os.listdir(tmp_path / "run/aggregates.csv") if p.endswith(".csv")]
    assert open(tmp_path / "run/aggregates.csv" / lines[0]).readline().strip() == "model,metric,n_themes,mean,std,median,p25,p75,min,max"


def test_factorial_effects_and_incomplete_studies(spark):
    rows = [("f", "full", "a", 1.0), ("f", "full", "b", 2.0), ("f", "cut", "a", 5.0), ("f", "cut", "b", 10.0), ("g", "full", "a", 1.0), ("f", "other", "a", 99.0)]
    levels = {"slicing": ("full", "cut"), "source": ("a", "b")}
    cells = spark.createDataFrame(rows, "feature string, slicing string, source string, kl double")
    got = {(r["feature"], r["term"]): r["kl"] for r in studies.factorial(cells, ["feature"], ("slicing", "source"), levels, ["kl"]).collect()}
    assert (got["f", "all"], got["f", "full"], got["f", "cut_b"]) == (4.5, 1.5, 10.0)
    assert (got["f", "effect_slicing"], got["f", "effect_source"], got["f", "effect_interaction"]) == (6.0, 3.0, 4.0)
    assert got["g", "effect_slicing"] is None and got["g", "full_a"] == 1.0
    wide = studies.wide_cells(cells, ["feature"], ("slicing", "source"), levels, ["kl"])
    back = studies.read_cells(wide, ["feature"], ("slicing", "source"), levels, ["kl"])
    assert sorted(tuple(r) for r in back.collect()) == sorted(r for r in rows if r[1] != "other")


# --- files --------------------------------------------------------------------------------------


def test_score_files_appear_together_or_not_at_all(spark, tmp_path):
    score_source.register(spark)
    folder = str(tmp_path / "scores")
    good = spark.createDataFrame([(f"a/{k}.bin", bytes([k])) for k in range(6)], "path string, content binary").repartition(3)
    good.write.format("segno_scores").mode("append").save(folder)
    read = lambda: {r["path"].rsplit("/scores/")[-1]: bytes(r["content"]) for r in spark.read.format("segno_scores").load(folder).collect()}
    assert read() == {f"a/{k}.bin": bytes([k]) for k in range(6)} and not [p for p in os.listdir(folder) if p.startswith("_")]

    fails = F.udf(lambda p: bytes(1) if not p.endswith("2") else 1 / 0, "binary")  # a task fails behind others that have written
    bad = spark.createDataFrame([(f"b/{k}",) for k in range(4)], "path string").repartition(4)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        bad.withColumn("content", fails("path")).write.format("segno_scores").mode("append").save(folder)
    assert len(read()) == 6 and not [p for p in os.listdir(folder) if p.startswith("_")]

    more = spark.createDataFrame([("c/new", b"x"), ("a/0.bin", b"y")], "path string, content binary")
    with pytest.raises(Exception, match="a/0.bin exists"):
        more.write.format("segno_scores").mode("append").save(folder)
    assert read() == {f"a/{k}.bin": bytes([k]) for k in range(6)}
    more.write.format("segno_scores").mode("overwrite").save(folder)
    assert read()["a/0.bin"] == b"y" and read()["c/new"] == b"x" and len(read()) == 7
    with pytest.raises(Exception, match="below the folder"):
        spark.createDataFrame([("../out", b"x")], "path string, content binary").write.format("segno_scores").mode("append").save(folder)


def test_score_files_are_planned_by_size_and_parsed(spark, tmp_path):
    score_source.register(spark)
    for k in range(5):
        (tmp_path / f"{k}.mid").write_bytes(scores.midi([{"pitch": 60 + k, "velocity": 90, "start_s": 0.0, "end_s": 0.5}]))
    (tmp_path / "bad.mid").write_bytes(b"no midi")
    (tmp_path / "other.txt").write_bytes(b"x")
    read = spark.read.format("segno_scores").option("kind", "midi").option("partition_bytes", 2 * score_source.FILE_BYTES).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 3
    assert sorted(r["pitch"] for r in read.where("error is null").collect()) == [60, 61, 62, 63, 64] and read.where("error is not null").count() == 1
    assert spark.read.format("segno_scores").load(str(tmp_path / "nothing")).count() == 0


def test_score_files_in_packs(spark, tmp_path, monkeypatch):
    """Files that are alike take less disk in packs than a block each, and come back one by one; a damaged pack is told."""
    score_source.register(spark)
    texts = {f"{k}-R.musicxml": scores.musicxml([{"offset_q": q / 2, "length_q": 0.5, "pitch": 50 + (k * q) % 40} for q in range(40)]).encode() for k in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "path string, content binary").coalesce(1)
    blocks = lambda f: sum(os.lstat(f"{f}/{x}").st_blocks * 512 for x in os.listdir(f))
    single, packs = str(tmp_path / "single"), str(tmp_path / "packs")
    rows.write.format("segno_scores").mode("append").save(single)
    rows.write.format("segno_scores").option("packs", "true").mode("append").save(packs)
    assert len(os.listdir(packs)) == 1 and blocks(packs) * 5 < blocks(single)
    load = lambda kind: spark.read.format("segno_scores").option("packs", "true").option("kind", kind).load(packs)
    assert {r["path"]: bytes(r["content"]) for r in load("files").collect()} == {f"{packs}/{k}": v for k, v in texts.items()}
    assert load("musicxml").where("kind = 'note'").groupBy("path").count().where("count >= 40").count() == 60

    writer = score_source.ScoreWriter(str(tmp_path / "small"), False, True)
    monkeypatch.setattr(score_source, "PACK_BYTES", 2 * len(texts["0-R.musicxml"]))
    writer.commit([writer.write(iter([{"path": p, "content": c} for p, c in texts.items()])), writer.write(iter([]))])
    held = os.listdir(tmp_path / "small")
    assert len(held) >= 20 and all(x.endswith(score_source.PACK) for x in held)
    reader = score_source.ScoreReader(str(tmp_path / "small"), "*.musicxml", None, score_source.StructType.fromDDL("path string, content binary"), 1 << 20, True)
    parts = reader.partitions()
    assert len(parts) == len(held) and sum(b.num_rows for p in parts for b in reader.read(p)) == 60
    with pytest.raises(ValueError, match="below the folder"):
        writer.write(iter([{"path": "../out", "content": b"x"}]))

    name = f"{packs}/{os.listdir(packs)[0]}"
    with open(name, "rb") as f:
        whole = f.read()
    with open(name, "wb") as f:
        f.write(whole[: len(whole) // 2])
    told = load("musicxml").where("error is not null").collect()
    assert [r["path"] for r in told] == [name] and 0 < load("musicxml").where("kind = 'note'").select("path").distinct().count() < 60
    with pytest.raises(Exception, match="EOFError|ReadError"):
        load("files").collect()


def test_snapshots_guard_a_run_and_files_are_set_aside(spark, tmp_path):
    run = str(tmp_path / "run")
    first = sinks.config_snapshot(spark, {"slug": "a", "bars": 8}, run)
    assert sinks.config_snapshot(spark, {"bars": 8, "slug": "a"}, run) == first
    with pytest.raises(ValueError, match="start it anew"):
        sinks.config_snapshot(spark, {"slug": "a", "bars": 4}, run)
    os.makedirs(tmp_path / "run/themes/x")
    (tmp_path / "run/themes/x/f").write_text("1")
    paths = spark.createDataFrame([("themes/x",), ("themes/none",), ("themes/x",)], "path string")
    assert {tuple(r) for r in sinks.set_aside(spark, paths, run, f"{run}/_trash").collect()} == {("themes/x", True), ("themes/none", False)}
    assert (tmp_path / "run/_trash/themes/x/f").read_text() == "1" and not (tmp_path / "run/themes/x").exists()


def test_an_observation_counts_what_was_skipped(spark, tmp_path):
    wanted = spark.createDataFrame([(k,) for k in range(6)], "name int")
    parsed = spark.createDataFrame([(0, 1, 60, None), (0, 2, 61, None), (1, 1, 60, None), (2, None, None, "bad"), (3, 1, 60, None), (3, 2, 62, None)], "name int, seq_no int, pitch int, error string")
    held, seen = loading.observed_status(wanted, parsed)
    held.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"ok": 2, "missing": 2, "parse_error": 1, "too_short": 1} and spark.read.parquet(str(tmp_path / "out")).count() == 2


# --- streams ------------------------------------------------------------------------------------


def test_tie_chains_stay_open_between_batches(spark, tmp_path):
    rng = random.Random(12)
    rows = [(p, k, rng.choice(["start", "continue", "stop", None]), rng.randrange(1, 9)) for p in ("a", "b", None) for k in range(40)]
    schema = "piece string, seq_no int, tie string, ticks int"
    want = domain.tie_chains(spark.createDataFrame(rows, schema), ["piece"], ["seq_no"]).groupBy("piece", "chain").agg(F.count(F.lit(1)).alias("n"), F.sum("ticks").alias("ticks"))
    cuts = [0, 3, 4, 17, 40]
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = [r for r in rows if low <= r[1] < high and not (r[0] == "b" and low == 3)] + [r for r in rows if r[0] == "b" and low == 4 and r[1] == 3]
        rng.shuffle(held)
        spark.createDataFrame(held, schema).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        streams.upsert_chains(stream, ["piece"], "seq_no", str(tmp_path / "out"), str(tmp_path / "state"))
    got = streams.latest_chains(spark, str(tmp_path / "out"), ["piece"])
    key = lambda r: (str(r["piece"]), r["chain"])
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_the_state_of_a_quiet_piece_goes(spark, tmp_path):
    schema = "piece string, seq_no int, tie string, ticks int"
    told = []
    for k, rows in enumerate(([("a", 1, "start", 2), ("b", 1, "start", 2)], [("c", 1, None, 1)], [("a", 2, "stop", 3)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        chains = streams.tie_chains(stream, ["piece"], "seq_no", quiet="1 milliseconds")
        chains.writeStream.outputMode("update").foreachBatch(lambda df, n: told.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination(120)
    assert ("a", 1, 1, 3, True) in told and ("a", 1, 2, 5, True) not in told and len(told) == 4


# --- scores from notes, tempi, tensors ----------------------------------------------------------


def line_of(spark, notes, bpm=120.0):
    rows = spark.createDataFrame([("p", k, p, a, b) for k, (p, a, b) in enumerate(notes)], "piece string, seq_no int, pitch int, start_s double, end_s double")
    return assembly.melody_line(rows, ["piece"], F.lit(bpm))


def events_of(spark, notes, chords=None, cycle=8.0):
    line = line_of(spark, notes)
    held = None if chords is None else spark.createDataFrame([("p", q, r, "major") for q, r in chords], "piece string, offset_q double, root_pc int, kind string")
    made = sinks.assembled_scores(assembly.with_chords(line, held, ["piece"], cycle), ["piece"]).first()["content"]
    return list(scores.parse_musicxml(bytes(made))), bytes(made)


def quarters(n):
    return [(60, k * 0.5, k * 0.5 + 0.5) for k in range(n)]


def test_quarters_become_notes(spark):
    events, _ = events_of(spark, quarters(4))
    assert [(e["offset_q"], e["length_q"]) for e in events if e["kind"] == "note"] == [(k, 1.0) for k in range(4)]


def test_measures_are_full_whatever_the_timing(spark):
    events, _ = events_of(spark, [(60 + k % 5, k * 0.5 + (k % 3 - 1) * 0.005, k * 0.5 + 0.45) for k in range(16)])
    assert [e["length_q"] for e in events if e["kind"] == "measure"] == [4.0] * 4


def test_triplets_are_marked_and_sixteenths_are_not(spark):
    third, sixteenth = 0.5 / 3, 0.125
    events, text = events_of(spark, [(60, k * third, (k + 1) * third) for k in range(3)])
    assert [round(e["offset_q"] * 3) for e in events if e["kind"] == "note"] == [0, 1, 2] and text.count(b"<actual-notes>3") == 3
    events, text = events_of(spark, [(60, k * sixteenth, (k + 1) * sixteenth) for k in range(4)])
    assert [e["offset_q"] for e in events if e["kind"] == "note"] == [0, 0.25, 0.5, 0.75] and b"actual-notes" not in text


def test_long_notes_stay_whole_within_a_bar_and_are_tied_beyond(spark):
    events, _ = events_of(spark, [(60, 0.0, 2.0)])
    assert [(e["length_q"], e["tie"]) for e in events if e["kind"] == "note"] == [(4.0, None)]
    events, _ = events_of(spark, [(60, 1.0, 5.0)])
    assert [(e["measure_no"], e["length_q"], e["tie"]) for e in events if e["kind"] == "note"] == [(1, 2.0, "start"), (2, 4.0, "continue"), (3, 2.0, "stop")]


def test_one_voice_and_short_notes(spark):
    got = [tuple(r) for r in line_of(spark, [(60, 0.0, 0.01), (64, 0.0, 0.5), (67, 0.25, 2.0), (65, 0.5, 0.75)]).select("pitch", "offset_q", "length_q").orderBy("offset_q").collect()]
    assert got == [(64, 0.0, 0.5), (67, 0.5, 0.5), (65, 1.0, 0.5)]


@pytest.mark.parametrize(("chords", "cycle", "bars", "want"), [
    ([(0.0, 0), (4.0, 7)], 8.0, 4, [(0.0, 0), (4.0, 7), (8.0, 0), (12.0, 7)]),
    ([], 8.0, 2, []),
    ([(0.0, 0), (4.0, 7), (6.0, 5)], 8.0, 3, [(0.0, 0), (4.0, 7), (6.0, 5), (8.0, 0)]),
    ([(0.0, 0), (9.0, 3)], 8.0, 2, [(0.0, 0)]),
])
def test_chords_repeat_and_end_with_the_piece(spark, chords, cycle, bars, want):
    events, _ = events_of(spark, quarters(bars * 4), chords, cycle)
    assert [(e["offset_q"], e["root_pc"]) for e in events if e["kind"] == "chord"] == want
    assert len([e for e in events if e["kind"] == "note"]) == bars * 4


def test_tempi_that_change_and_are_missing(spark):
    notes = spark.createDataFrame([("a", 0.0, 2.0), ("a", 3.0, 2.0), ("a", 8.0, 1.0), ("b", 3.0, 3.0)], "piece string, offset_q double, length_q double")
    tempos = spark.createDataFrame([("a", 1.0, 60.0), ("a", 4.0, 120.0), ("a", 4.0, 90.0)], "piece string, offset_q double, bpm double")
    got = [(r["piece"], r["start_s"], r["end_s"]) for r in domain.with_tempi(notes, tempos, ["piece"]).orderBy("piece", "offset_q").collect()]
    assert got == [("a", 0.0, 2.0), ("a", 3.0, 4.5), ("a", 6.0, 6.5), ("b", 1.0, 2.0)]


def test_tensors_need_notes_and_chords_with_tones(spark):
    by = ["piece"]
    notes = spark.createDataFrame([("a", 0, 61, 0.0, 1.0), ("a", 1, 63, 2.0, 0.5)], "piece string, seq_no int, pitch int, offset_q double, length_q double")
    chords = spark.createDataFrame([("a", 0, 0.0, [0, 4])], "piece string, seq_no int, offset_q double, pcs array<int>")
    pieces = spark.createDataFrame([("a",)], "piece string")
    row = domain.tensors(notes, chords, pieces, by, 2, 1, 8).first()
    assert row["base_note"] == 60 and row["rhythm"] == [2, 1, 0, 0, 2, 0, 0, 0] and row["pitch"] == [1, 48, 49, 49, 3, 49, 49, 49]
    assert len(row["chord"]) == 17 and row["chord"][16] == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 0, 0, 0, 0]
    with pytest.raises(Exception, match="no notes in"):
        domain.tensors(notes, chords, pieces.unionByName(spark.createDataFrame([("b",)], "piece string")), by, 2, 1, 8).collect()
    with pytest.raises(Exception, match="a chord has no pitch class"):
        domain.tensors(notes, chords.withColumn("pcs", F.array().cast("array<int>")), pieces, by, 2, 1, 8).collect()


def test_melodies_trims_and_skipped_scores(spark):
    notes = spark.createDataFrame([(1, 1), (1, 2), (2, 0)], "piece_id long, part_no int")
    pieces = spark.createDataFrame([(1,), (2,)], "piece_id long")
    assert {tuple(r) for r in domain.melody_of(pieces, notes).collect()} == {(1, 1), (2, 0)}
    with pytest.raises(Exception, match="no part with notes"):
        domain.melody_of(pieces.unionByName(spark.createDataFrame([(3,)], "piece_id long")), notes).collect()
    bars = spark.createDataFrame([(1, k) for k in range(4)] + [(2, k) for k in range(3)], "piece_id long, measure_no int")
    assert sorted(tuple(r) for r in domain.trimmed(bars, 3).collect()) == [(1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]
    measures = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "piece_id long, part_no int, measure_no int")
    status, held = domain.generated_measures(spark.createDataFrame([(1,), (2,), (9,)], "piece_id long"), measures, notes)
    assert {tuple(r) for r in status.collect()} == {(1, "ok"), (2, "no_measures"), (9, "no_melody")} and held.count() == 1


def test_sqlite_is_scanned_by_ranges_with_its_filters(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "a b.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "my table" (k INTEGER, "odd ""name" VARCHAR(9), x REAL, raw BLOB)')
        db.executemany('INSERT INTO "my table" VALUES (?, ?, ?, ?)', [(k, None if k % 7 == 0 else f"n{k}", k / 4, bytes([k])) for k in range(100)])
        db.execute('DELETE FROM "my table" WHERE k BETWEEN 20 AND 69')
        db.execute("CREATE TABLE empty (a INTEGER)")
    sqlite_source.register(spark)
    read = lambda name: spark.read.format("segno_sqlite").option("table", name).option("partition_rows", 9).load(path)
    rows = read("my table")
    assert rows.dtypes == [("k", "bigint"), ('odd "name', "string"), ("x", "double"), ("raw", "binary")] and rows.count() == 50
    got = rows.where("k >= 15 and x < 20 and raw is not null").collect()
    assert sorted(r["k"] for r in got) == [*range(15, 20), *range(70, 80)] and {r['odd "name'] for r in got if r["k"] in (70, 71)} == {None, "n71"}
    assert read("empty").count() == 0
    with pytest.raises(Exception, match="no table other"):
        read("other").count()
    assert sqlite_source.write_table(spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "i int, s string, d double"), path, "made") == 2
    assert sorted(map(tuple, read("made").collect())) == [(1, "a", 2.5), (2, None, None)]


def test_copies_of_vectors_are_paired_once_and_weigh(spark):
    rng = random.Random(11)
    some = [[float(rng.randrange(4)), float(rng.randrange(3))] for _ in range(12)]
    real = [("f", k, some[rng.randrange(12)]) for k in range(300)]
    made = [("f", k, some[rng.randrange(12)], "u") for k in range(200)]
    df = spark.createDataFrame(real, "feature string, id long, vec array<float>"), spark.createDataFrame(made, "feature string, id long, vec array<float>, model string")
    for block in (5, distances.BLOCK):
        found = distances.distance_samples(*df, ["feature"], block=block)
        got = {r["kind"]: r for r in distances.distance_summary(found, ["feature"]).collect()}
        own = [math.dist(a[2], b[2]) for a in real for b in real if a[1] != b[1]]
        other = [math.dist(a[2], b[2]) for a in real for b in made]
        for kind, want in (("intra", own), ("inter", other)):
            r = got[kind]
            assert r["n"] == len(want) and (r["low"], r["high"], r["mean"]) == pytest.approx((min(want), max(want), sum(want) / len(want)))
        # What is written is a row per distinct distance at most for each task, not a row per pair of blocks.
        assert found.count() <= 2 * len({round(x, 9) for x in other}) * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_strips_put_together_keep_weight_mean_and_spread(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, (150, 3)), rng.normal(1, 2, (170, 3))
    wa, wb = rng.integers(1, 5, 150), rng.integers(1, 5, 170)
    monkeypatch.setattr(distances, "STRIP", 600)
    monkeypatch.setattr(distances, "FINE", 128)
    monkeypatch.setattr(distances, "WAITING", 512)
    every = np.repeat(a, wa, axis=0)
    own = distances.pairwise(every, every)[np.triu_indices(len(every), 1)]
    other = distances.pairwise(every, np.repeat(b, wb, axis=0)).ravel()
    for found, want in ((distances.block_clusters(a, None, wa, None), own), (distances.block_clusters(a, b, wa, wb), other)):
        w, mean, m2 = found.all(128)
        assert w.sum() == len(want) and (w * mean).sum() == pytest.approx(want.sum()) and len(w) <= 128
        assert (m2 + w * (mean - want.mean()) ** 2).sum() == pytest.approx(((want - want.mean()) ** 2).sum()) and (found.low, found.high) == pytest.approx((want.min(), want.max()), abs=1e-9)


@pytest.mark.parametrize("kind", ["whole", "line", "filed"])
def test_many_pairs_are_measured_with_less_work_and_right(monkeypatch, kind):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(distances, "BINS", 256)
    monkeypatch.setattr(distances, "TILE_ROWS", 32)
    monkeypatch.setattr(distances, "STRIP", 1 << 11)
    monkeypatch.setattr(distances, "MANY", 1 << 12)
    make = {"whole": lambda n: rng.poisson(2, (n, 3)), "line": lambda n: rng.gamma(2, 1, (n, 1)), "filed": lambda n: rng.normal(0, 1, (n, 3))}[kind]
    a, b = (np.unique(make(n).astype(float), axis=0) for n in (300, 280))
    if kind == "filed":
        a[0], b[0] = 7.0, 7.0 + 1e-9  # a pair that the matrix product cannot tell from none
    wa, wb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
    calls = []
    name = {"whole": "_counted", "line": "_on_a_line", "filed": "_filed"}[kind]
    plain = getattr(distances, name)
    monkeypatch.setattr(distances, name, lambda *x: (calls.append(1), plain(*x)))
    every = np.repeat(a, wa, axis=0)
    exact = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    own, other = exact(every, every)[np.triu_indices(len(every), 1)], exact(every, np.repeat(b, wb, axis=0)).ravel()
    for found, want in ((distances.block_clusters(a, None, wa, None), own), (distances.block_clusters(a, b, wa, wb), other)):
        w, mean, m2 = found.all()
        assert w.sum() == len(want) and (w * mean).sum() == pytest.approx(want.sum(), rel=1e-9)
        assert (m2 + w * (mean - want.mean()) ** 2).sum() == pytest.approx(((want - want.mean()) ** 2).sum(), rel=1e-6)
        assert (found.low, found.high) == pytest.approx((want.min(), want.max()), abs=1e-12)
        places = np.quantile(want, [0.1, 0.5, 0.9]) + 1e-4
        width = (found.high - found.low) / (64 if kind == "line" else 4096)
        for at in places:  # what lies below a place, to a bin's width
            below = w[mean <= at].sum()
            assert (want <= at - width).sum() <= below <= (want <= at + width).sum()
    assert len(calls) == 2


def test_the_real_pieces_as_a_model_have_each_pair_twice_and_themselves(spark):
    rng = random.Random(5)
    real = [("f", k, [float(rng.randrange(5)), rng.random()]) for k in range(30)] + [("g", 0, [1.0])]
    made = [("f", k, [rng.random(), 1.0], "u") for k in range(9)]
    df = spark.createDataFrame(real, "feature string, id long, vec array<double>"), spark.createDataFrame(made, "feature string, id long, vec array<double>, model string")
    samples = distances.with_own(distances.distance_samples(*df, ["feature"]), df[0], ["feature"], "N")
    got = {(r["feature"], r["model"], r["kind"]): r for r in distances.distance_summary(samples, ["feature"]).collect()}
    want = [math.dist(a[2], b[2]) for a in real for b in real if a[0] == b[0] == "f"]
    r = got["f", "N", "inter"]
    assert r["n"] == 900 and (r["low"], r["high"], r["mean"]) == pytest.approx((0.0, max(want), sum(want) / 900))
    assert got["g", "N", "inter"]["n"] == 1 and ("g", None, "intra") not in got and got["f", "u", "inter"]["n"] == 270


def test_halves_of_all_trials_are_measured_in_one_pass(spark, monkeypatch):
    rng = random.Random(12)
    rows = [("f", k, [float(rng.randrange(4)), rng.random() if k % 3 else 0.5]) for k in range(61)]
    vectors = spark.createDataFrame(rows, "feature string, id long, vec array<double>")
    seeds = [4, 9, 5]
    cut = {(r["trial"], r["id"]): r["half"] for r in studies.sampling.halves(vectors.select("id"), "id", seeds).collect()}
    first = spark.createDataFrame([(k, sum(1 << t for t, s in enumerate(seeds) if cut[s, k] == "a")) for k in range(61)], "id long, first long")
    samples = distances.half_samples(vectors.join(first, "id"), ["feature"], seeds)
    got = {(r["trial"], r["kind"]): r for r in distances.distance_summary(samples, ["feature", "trial"]).collect()}
    for seed in seeds:
        a, b = ([r[2] for r in rows if cut[seed, r[1]] == h] for h in "ab")
        for kind, want in (("intra", [math.dist(x, y) for i, x in enumerate(a) for j, y in enumerate(a) if i != j]), ("inter", [math.dist(x, y) for x in a for y in b])):
            r = got[seed, kind]
            assert r["n"] == len(want) and (r["low"], r["high"], r["mean"]) == pytest.approx((min(want), max(want), sum(want) / len(want)))
    whole = {r["trial"]: (r["kl"], r["oa"]) for r in studies.half_noise(vectors, ["feature"], seeds).collect()}
    monkeypatch.setattr(studies, "MOST_AT_ONCE", 2)
    split = {r["trial"]: (r["kl"], r["oa"]) for r in studies.half_noise(vectors, ["feature"], seeds).collect()}
    assert len(whole) == 3 and all(split[t] == pytest.approx(whole[t]) for t in seeds)


def test_chains_of_a_batch_go_on_from_those_held(spark):
    rng = random.Random(4)
    kinds = ["start", "continue", "stop", None, "odd"]
    rows = [(p, k, rng.choice(kinds), rng.randrange(1, 5)) for p in range(12) for k in range(15)]
    held, told, schema = None, {}, "piece long, seq_no long, tie string, ticks int"
    for number, (low, high) in enumerate(((0, 4), (5, 9), (10, 14))):
        # Some pieces are silent in the second batch, and their chains stay open.
        batch = [r for r in rows if low <= r[1] <= high and not (number == 1 and r[0] % 3 == 0)]
        found = streams.changed_chains(spark.createDataFrame(batch, schema), held, ["piece"], "seq_no").collect()
        assert {r["piece"] for r in found if r["told"]} == {r[0] for r in batch} and sum(r["open"] for r in found) == 12
        told |= {(r["piece"], r["chain"]): (r["n"], r["ticks"]) for r in found if r["told"]}
        held = spark.createDataFrame([tuple(r[c] for c in ("piece", "chain", "n", "ticks", "may")) for r in found if r["open"]], "piece long, chain long, n long, ticks long, may boolean")
    heard = [r for r in rows if not (r[0] % 3 == 0 and 5 <= r[1] <= 9)]
    want: dict = {}
    for p in range(12):
        chain, may = 0, False
        for _, _, tie, ticks in (r for r in heard if r[0] == p):
            chain += not (may and tie in ("continue", "stop"))
            may = tie == "start" or (may and tie is not None)
            n, total = want.get((p, chain), (0, 0))
            want[p, chain] = (n + 1, total + ticks)
    assert told == want


def test_a_score_is_assembled_from_one_shuffle_of_its_notes(spark):
    """Notes that are dealt by piece are not dealt again for grids, the one voice, lengths and the chords of all bars."""
    rows = spark.createDataFrame([("p", 60 + k, k * 0.5, k * 0.5 + 0.5) for k in range(8)], "piece string, pitch int, start_s double, end_s double")
    rows = rows.withColumn("seq_no", F.row_number().over(Window.partitionBy("piece").orderBy("start_s")))
    chords = spark.createDataFrame([("p", 0.0, 0, "major"), ("p", 3.0, None, "major"), ("p", 9.0, 2, "minor")], "piece string, offset_q double, root_pc int, kind string")
    made = assembly.with_chords(assembly.melody_line(rows, ["piece"], F.lit(120.0)), chords, ["piece"], 4.0)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # notes; chords
    got = made.first()
    assert len(got["notes"]) == 8 and [(c["offset_q"], c["root_pc"]) for c in got["chords"]] == [(0.0, 0), (4.0, 0)]


def test_assembled_notes_are_not_dealt_again_for_their_chords(spark):
    """However many partitions shuffles have: the notes and the chords are dealt once each, to as many tasks."""
    from segno.plans import scores as plan

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        told = plan.assembled(spark, "/root/testdata/sf0.001", 0, 1, 12)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert told.count("Exchange hashpartitioning") == 2 == told.count("REPARTITION_BY_NUM")


def test_a_score_that_cannot_be_read_back_is_no_row_less(spark, monkeypatch):
    from segno.plans import scores as plan

    whole = plan.assembled
    monkeypatch.setattr(plan, "assembled", lambda *a: whole(*a).withColumn("content", F.when(F.col("path").startswith("1-"), F.lit(b"<score")).otherwise(F.col("content"))))
    with pytest.raises(Exception, match="1-.*ParseError"):
        plan.score_assembly(spark, "/root/testdata/sf0.001").collect()


def test_scores_are_assembled_in_portions_that_leave_no_shuffle_files(spark, monkeypatch):
    """Portions of the themes give what all at once do, and the notes' shuffle files go when a portion is written."""
    from segno.plans import scores as plan

    def shuffle_files():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).getName().startswith("shuffle") for k in range(files.size()))

    d, left = "/root/testdata/sf0.001", []
    whole = sorted(map(str, plan.score_assembly(spark, d).collect()))
    kept = plan.shuffles_dropped

    @contextlib.contextmanager
    def seen(session):
        before = shuffle_files()
        with kept(session):
            yield
        end = time.time() + 10
        while shuffle_files() > before and time.time() < end:
            time.sleep(0.1)
        left.append(shuffle_files() - before)

    monkeypatch.setattr(plan, "shuffles_dropped", seen)
    monkeypatch.setattr(plan, "PORTION_NOTES", 2000)
    setting = spark.conf.get(shared.FILE_CLEANUP)
    assert sorted(map(str, plan.score_assembly(spark, d).collect())) == whole
    assert len(left) > 1 and max(left) <= 0 and spark.conf.get(shared.FILE_CLEANUP) == setting
