"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from segno.functions import music
from segno.operators import copying, corpus_features, distances, divergence, domain, relational, sampling, state, summary
from segno.operators import segment_metrics as seg

NOTE = "theme long, model string, sample_idx int, chunk_idx int, seq_no int, pitch int, start_s double, end_s double"
CHORD = "theme long, chunk_idx int, seq_no int, offset_q double, root_pc int, kind string"


def notes(spark, pitches, starts=None, length=0.5):
    starts = starts or [0.5 * k for k in range(len(pitches))]
    return spark.createDataFrame([(1, "m", 0, 0, k, p, s, s + length) for k, (p, s) in enumerate(zip(pitches, starts, strict=True))], NOTE)


def cmaj7(spark):
    return music.with_pitch_classes(spark.createDataFrame([(1, 0, 0, 0.0, 0, "major-seventh")], CHORD))


@pytest.mark.parametrize(("pitches", "expected"), [([60, 64, 67, 71], 1.0), ([61, 63, 66, 68], 0.0), ([60, 61, 64, 63], 0.5)])
def test_chord_tone_ratio(spark, pitches, expected):
    assert seg.chord_metrics(notes(spark, pitches), cmaj7(spark)).first()["ctr"] == expected


def test_ratios_without_chords_are_null(spark):
    none = cmaj7(spark).limit(0)
    assert seg.chord_metrics(notes(spark, [60]), none).first()["ctr"] is None


def test_first_beat_keeps_notes_near_a_downbeat(spark):
    near = seg.chord_metrics(notes(spark, [60], [0.02]), cmaj7(spark)).first()
    far = seg.chord_metrics(notes(spark, [60], [0.05]), cmaj7(spark)).first()
    both = seg.chord_metrics(notes(spark, [60, 61], [0.0, 2.0]), cmaj7(spark)).first()
    assert (near["ctr_first_beat"], far["ctr_first_beat"], both["ctr_first_beat"]) == (1.0, None, 0.5)


def test_weighted_scale_match(spark):
    rows = [(1, "m", 0, 0, 0, 60, 0.0, 2.0), (1, "m", 0, 0, 1, 61, 2.0, 2.5)]
    assert seg.chord_metrics(spark.createDataFrame(rows, NOTE), cmaj7(spark)).first()["scale_match_per_time"] == pytest.approx(0.8)


@pytest.mark.parametrize(("root", "kind", "pcs"), [(0, "major-seventh", {0, 2, 4, 5, 7, 9, 11}), (2, "minor-seventh", {0, 2, 4, 5, 7, 9, 11}), (7, "dominant", {0, 2, 4, 5, 7, 9, 11}), (0, "minor", {0, 2, 3, 5, 7, 9, 10}), (0, "unheard-of", {0, 2, 4, 5, 7, 9, 11})])
def test_scales(spark, root, kind, pcs):
    rows = music.with_pitch_classes(spark.createDataFrame([(1, 0, 0, 0.0, root, kind)], CHORD))
    assert set(rows.first()["scale_pcs"]) == pcs


def test_pitch_entropy(spark):
    of = lambda p: seg.pitch_entropy(notes(spark, p)).first()["pitch_entropy"]
    assert (of([60, 72, 48]), of([60, 61])) == (0.0, 1.0)
    assert of(list(range(60, 72))) == pytest.approx(math.log2(12))


@pytest.mark.parametrize(("own", "theme", "expected"), [([60, 62, 64, 60], [72, 74, 76, 72], 1.0), ([60, 62, 64, 65], [72, 70, 68, 67], 0.0), ([60, 62, 64, 60, 62], [72, 74, 76, 72], 0.5)])
def test_theme_ngrams(spark, own, theme, expected):
    melody = spark.createDataFrame([(1, 0, theme)], "theme long, chunk_idx int, melody array<int>")
    assert seg.theme_overlap(notes(spark, own), melody, (3,)).first()["ngram_3_overlap"] == expected


def test_asof_join_takes_the_last_of_equal_places(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 9.0)], "g int, t double")
    right = spark.createDataFrame([(1, 1.0, 0, "a"), (1, 1.0, 1, "b"), (1, 5.0, 2, "c")], "g int, u double, k int, v string")
    got = relational.asof_join(left, right, ["g"], "t", "u", "k").orderBy("t").collect()
    assert [r["match"] and r["match"]["v"] for r in got] == [None, "b", "c"]


def test_required_join_names_what_is_missing(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    with pytest.raises(Exception, match="no row for"):
        relational.required_join(a, a.where("k = 'x'"), ["k"], "no row for ").collect()


PIECE = "piece string, instr int, seq_no int, pitch int, velocity int, start_s double, end_s double"


def piece(spark, pitches, lengths):
    rows, at = [], 0.0
    for k, (p, n) in enumerate(zip(pitches, lengths, strict=True)):
        rows.append(("p", 0, k, p, 80, at, at + n))
        at += n
    return spark.createDataFrame(rows, PIECE), spark.createDataFrame([("p", 60.0, 4, 4)], "piece string, tempo_bpm double, ts_num int, ts_den int")


def test_features(spark):
    rows, of = piece(spark, [60, 64, 60, 67, 60, 60, 60], [2.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5])
    got = {r["feature"]: r["vec"] for r in corpus_features.all_features(rows, of, ["piece"]).collect()}
    assert got["total_used_pitch"] == [3.0] and got["total_used_note"] == [7.0] and got["pitch_range"] == [7.0]
    assert got["note_length_hist"][1:4] == pytest.approx([1 / 7, 2 / 7, 4 / 7])
    assert got["note_length_transition_matrix"][2 * 12 + 2] == 1.0 and sum(got["note_length_transition_matrix"]) == 6
    assert sum(got["pitch_class_transition_matrix"]) == 6


def test_jensen_shannon_bounds(spark):
    real = spark.createDataFrame([("a",), ("b",)], "pattern string")
    made = spark.createDataFrame([("same", "a"), ("same", "b"), ("other", "c")], "model string, pattern string")
    got = {r["model"]: r["jsd"] for r in divergence.jensen_shannon(real, made, "pattern").collect()}
    assert got["same"] == pytest.approx(0.0) and got["other"] == pytest.approx(math.log(2))


def test_kl_and_overlap_separate_equal_from_distant_corpora(spark):
    import random

    rng = random.Random(3)
    vec = lambda k, m: [(f"{k}{i}", [rng.gauss(m, 1)]) for i in range(40)]
    real = spark.createDataFrame([("f", i, v) for i, v in vec("r", 0)], "feature string, id string, vec array<double>")
    rows = [("f", i, v, "same") for i, v in vec("s", 0)] + [("f", i, v, "far") for i, v in vec("t", 50)]
    made = spark.createDataFrame(rows, "feature string, id string, vec array<double>, model string")
    samples = distances.distance_samples(real, made, ["feature"], block=16)
    got = {r["model"]: r for r in divergence.kl_and_overlap(samples, ["feature"]).collect()}
    assert got["same"]["oa"] > 0.8 and got["far"]["oa"] < 0.05 and got["same"]["kl"] < 0.3


def test_mann_whitney_exact_and_normal():
    assert divergence.p_value(4, 9, 3.0, 0) is None
    assert divergence.p_value(5, 5, 0.0, 0) == pytest.approx(2 / 252)
    assert divergence.p_value(5, 5, 12.5, 0) == pytest.approx(1.0)
    assert 0.0 < divergence.p_value(30, 30, 200.0, 6) < 0.01


@pytest.mark.parametrize(("a", "b", "expected"), [([1, 2, 3, 4, 5], [9, 2, 3, 4, 8], 3), ([1, 99, 2, 99, 3], [1, 2, 3], 1), ([-5, 3, -7, 12], [99, -5, 3, -7, 88], 3), ([1], [2], 0)])
def test_longest_common_run(spark, a, b, expected):
    made = spark.createDataFrame([("m", 1, a)], "model string, chunk int, seq array<int>")
    train = spark.createDataFrame([(7, b)], "piece int, seq array<int>")
    assert copying.longest_common_runs(made, train).first()["lcs"] == expected


def test_pooled_overlap_counts_repeats(spark):
    train = spark.createDataFrame([([1, 2, 3],)], "seq array<int>")
    made = spark.createDataFrame([("m", [1, 2, 3] * 4)], "model string, seq array<int>")
    got = copying.pooled_overlap(train, made, 3).first()
    assert (got["n_grams"], got["n_copied"]) == (10, 4)


BAR = "bar int, offset_q double, length_q double, pitch int"


@pytest.mark.parametrize(
    ("rows", "pattern"),
    [
        ([(1, float(k), 1.0, 60) for k in range(4)], "OHHHOHHHOHHHOHHH"),
        ([(1, 0.0, 4.0, None)], "R" * 16),
        ([(1, k / 4, 0.25, 60) for k in range(16)], "O" * 16),
        ([(1, k / 2, 0.5, 60) for k in range(8)], "OHOHOHOHOHOHOHOH"),
        ([(1, 0.0, 1 / 3, 60), (1, 1 / 3, 1 / 3, 60), (1, 2 / 3, 1 / 3, 60)], "OORORRRRRRRRRRRR"),
    ],
)
def test_bar_patterns(spark, rows, pattern):
    assert domain.bar_patterns(spark.createDataFrame(rows, BAR), ["bar"]).first()["pattern"] == pattern


def test_bar_patterns_take_one_aggregation(spark):
    rows = [("a", 0.0, 9.0, 60), ("a", 1.0, 0.0, 61), ("b", 1.0, 1.0, None), ("c", -1.0, 9.0, 60), (None, 0.0, 1.0, 60)]
    got = domain.bar_patterns(spark.createDataFrame(rows, "bar string, offset_q double, length_q double, pitch int"), ["bar"])
    assert {r["bar"]: r["pattern"] for r in got.collect()} == {"a": "OHHHOHHHHHHHHHHH", "b": "R" * 16, "c": "R" * 16, None: "R" * 16}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_detie_and_snap(spark):
    rows = [("p", 0, 1, "start"), ("p", 1, 1, "stop"), ("p", 2, 4, "start"), ("p", 3, 1, "stop"), ("p", 4, 2, None)]
    held = spark.createDataFrame(rows, "piece string, seq_no int, ticks int, tie string")
    words = spark.createDataFrame([(1,), (2,), (4,)], "ticks int")
    got = domain.detied(held, words, ["piece"], ["seq_no"]).orderBy("seq_no").collect()
    assert [r["tie"] for r in got] == ["start", "stop", None, None, None]
    snapped = domain.snapped(spark.createDataFrame([(3,), (5,)], "ticks int"), [1, 2, 4]).collect()
    assert [r["ticks"] for r in snapped] == [2, 4]


def test_transposition_targets(spark):
    rows = spark.createDataFrame([(2, "major"), (4, "minor"), (0, "major")], "t int, m string")
    assert [r[0] for r in rows.select(music.transposition(F.col("t"), F.col("m"))).collect()] == [-2, 5, 0]


def test_cyclic_chords(spark):
    held = spark.createDataFrame([(1, 0.0), (1, 4.0)], "theme int, offset_q double")
    assert sorted(r["offset_q"] for r in domain.cyclic_chords(held, ["theme"], 8.0, 16.0).collect()) == [0.0, 4.0, 8.0, 12.0]


def test_melody_beyond_the_range_is_an_error(spark):
    held = spark.createDataFrame([(1, 0, 72, 0.0, 1.0), (1, 1, 120, 1.0, 1.0)], "p int, seq_no int, pitch int, offset_q double, length_q double")
    frames = spark.createDataFrame([(1, k) for k in range(8)], "p int, frame int")
    with pytest.raises(Exception, match="beyond the range"):
        domain.melody_frames(held, frames, ["p"], 4, 48).collect()


def test_split_is_repeatable_disjoint_and_sized(spark):
    names = spark.createDataFrame([(f"s{k}",) for k in range(100)], "name string")
    a, b = (sorted(map(tuple, sampling.split(names.repartition(n), "name", 0, 0.1, ["s1"]).collect())) for n in (1, 5))
    assert a == b and len({x for x, _ in a}) == len(a)
    sizes = {k: sum(bucket == k for _, bucket in a) for k in ("train", "eval", "test")}
    assert sizes["eval"] == 10 and sizes["train"] == 80 and sizes["test"] in (9, 10)


def test_derived_status(spark):
    themes = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "theme string, removed boolean")
    rows = [(t, m, k, not (t == "b" and m == "alto" and k)) for t in "abc" for m in ("alto", "tenor") for k in range(2)]
    samples = spark.createDataFrame(rows, "theme string, model string, sample_idx int, ok boolean")
    got = {r["theme"]: (r["status"], r["excluded_due_to"]) for r in state.derived_status(themes, samples, ["alto", "tenor"], 2).collect()}
    assert got == {"a": ("ok", None), "b": ("fail", "alto"), "c": ("fail", "removed_from_corpus")}


def test_cells(spark):
    rows = [("A", 1.5625, None), ("B", None, 0.5), ("C", None, None)]
    held = spark.createDataFrame(rows, "grp string, mean double, kl double")
    for c in summary.STATS:
        if c not in held.columns:
            held = held.withColumn(c, F.lit(None).cast("double"))
    cells = [r[0] for r in held.select(summary.cell(F.col("grp"))).collect()]
    assert cells == ["mean = 1.562 ± —\nmedian = — (—–—)", "KL = 0.500\nOA = —", "—"]


def test_places_are_those_of_exact_decimals(spark):
    import random

    from segno.functions import music

    rng = random.Random(3)
    values = [0.0025, 0.0005, 1.0005, 2.0015, -0.0005, -0.0001, 0.0, 2.5, 1e7 + 0.0005, 0.125, 0.0625, 0.1875, -3.0625] + [rng.randrange(10**6) / 2000 for _ in range(300)] + [rng.gauss(0, 50) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", music.places(F.col("x"), 3).alias("a"), music.places(F.col("x"), 6).alias("b"))
    assert [(r["a"], r["b"]) for r in df.collect()] == [(f"{x:.3f}", f"{x:.6f}") for x in values]


def test_slices_of_bars_and_of_downbeats(spark):
    notes = spark.createDataFrame([("p", k, 60, s, e) for k, (s, e) in enumerate([(0.0, 1.0), (6.0, 8.0)])], "piece string, seq_no int, pitch int, start_s double, end_s double")
    pieces = spark.createDataFrame([("p", 120.0, 4, 4)], "piece string, tempo_bpm double, ts_num int, ts_den int")
    bars = lambda n: sorted((r["window"], r["start_s"], r["end_s"]) for r in domain.slice_bars(notes, pieces, ["piece"], n).collect())
    beats = lambda n: sorted((r["window"], r["pitch"]) for r in domain.slice_downbeats(notes, pieces, ["piece"], n).collect())
    assert bars(1) == [(0, 0.0, 1.0), (3, 0.0, 2.0)] and bars(2) == [(0, 0.0, 1.0), (1, 2.0, 4.0)] and bars(5) == []
    assert beats(2) == [(0, 60)] and beats(1) == [(0, 60), (1, None), (2, None)] and beats(4) == []


def test_failures_of_removed_themes_and_without_error(spark):
    from segno.operators import state

    samples = spark.createDataFrame([("a", "alto", 0, False, "x"), ("a", "alto", 1, False, None), ("b", "alto", 0, False, "y"), ("a", "tenor", 0, True, None)], "theme string, model string, sample_idx int, ok boolean, error string")
    themes = spark.createDataFrame([("a", False), ("b", True)], "theme string, removed boolean")
    assert sorted(r["value"].split("— ")[1] for r in state.failures(samples, themes).collect()) == ["unknown", "x"]


def test_rank_tests_of_few_and_of_no_values(spark):
    rows = [("m", "x", float(k)) for k in range(6)] + [("m", "y", float(k)) for k in range(3)] + [("empty", "x", None), ("empty", "y", None)]
    got = {r["metric"]: r for r in divergence.mann_whitney(spark.createDataFrame(rows, "metric string, model string, value double"), ["metric"], ["x", "y"]).collect()}
    assert (got["m"]["n_a"], got["m"]["n_b"], got["m"]["u_statistic"], got["m"]["p_value"], got["m"]["significant"]) == (6, 3, None, None, False)
    assert (got["empty"]["n_a"], got["empty"]["n_b"], got["empty"]["u_statistic"]) == (0, 0, None)
