import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekin.operators import clean, encode, profile, report
from tablekin.roles import Roles, split_roles
from tablekin.sources import tables as src

# Published metric means by number of shuffled columns, and their step differences.
CROSS_BY_RUN = [1.00, 0.98, 0.98, 0.95, 0.92, 0.85, 0.80]
KAPPA_BY_RUN = [1.00, 0.45, 0.31, 0.25, 0.22, 0.18, 0.16]


def test_step_difference(spark):
    rows = [("cross", k, v) for k, v in enumerate(CROSS_BY_RUN)] + [("kappa", k, v) for k, v in enumerate(KAPPA_BY_RUN)]
    out = report.step_difference(spark.createDataFrame(rows, "metric string, run int, value double"))
    got = {(r["metric"], r["run"]): (r["step"], r["is_min"], r["is_max"]) for r in out.collect()}
    assert got["cross", 0] == (0.02, True, False) and got["kappa", 0] == (0.55, False, True)
    assert [got["cross", k][0] for k in range(6)] == pytest.approx([0.02, 0.0, 0.03, 0.03, 0.07, 0.05])


def test_conditional_round(spark):
    df = spark.createDataFrame([(0.12345,), (0.0005,), (2.5,), (3.5,)], "x double")
    got = [r[0] for r in df.select(report.conditional_round(F.col("x"))).collect()]
    assert got == [0.123, 0.0, 2.0, 4.0]


def test_quantiles_of_a_hot_group(spark):
    draw = np.random.default_rng(0)
    values = {"hot": np.r_[np.zeros(3000), draw.normal(size=3001)], "one": np.array([7.0]), "few": draw.normal(size=6)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    for r in report.exact_quantiles(df, ["g"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect():
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(list(np.quantile(values[r["g"]], [0.25, 0.5, 0.75])))


def test_nested_results_survive_a_round_trip(spark, tmp_path):
    scores = spark.createDataFrame(
        [("rf", "x", f"run {k}", t, m, v + k) for k in (0, 1) for t, m, v in (("a", "rbo", 0.5), ("b", "rbo", 0.25))],
        "method string, dataset string, run string, target string, metric string, value double",
    )
    cross = spark.createDataFrame(
        [("rf", "x", f"run {k}", s, c, 2.0, 1.0, 2.0 + k) for k in (0, 1) for s in ("real_synth", "synth_real") for c in ("a", "b")],
        "method string, dataset string, run string, type string, column string, ratio double, own double, other double",
    )
    path = str(tmp_path / "json")
    src.write_results_json(src.nest_results(scores, cross), path)
    read = src.read_results_json(spark, path)
    assert {(r["method"], r["dataset"], r["run"]) for r in read.collect()} == {("rf", "x", "run 0"), ("rf", "x", "run 1")}
    flat = report.strip_prefix_cast(report.flatten_results(read, ["method", "dataset"]), "run")
    assert flat.where("metric = 'rbo' AND run = 1 AND target = 'b'").first()["value"] == 1.25
    assert flat.where("metric = 'ratio_rs_sr'").count() == 4
    assert report.extract_cross(read).where("run = 'run 1'").first()["other"] == 3.0


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert clean.most_frequent(df, ["x"]).first()["mode"] == "a"
    filled = clean.impute_most_frequent(df, ["x"])
    assert sorted(r["x"] for r in filled.collect()) == ["a", "a", "a", "b", "b"]


def test_unseen_category_raises(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("x",), ("z",)], "c string")
    dictionary = encode.fit_dictionary(a, ["c"])
    assert [tuple(r) for r in encode.unseen_categories(b, dictionary, ["c"]).collect()] == [("c", "z", 1)]
    with pytest.raises(Exception, match="unseen category"):
        encode.apply_dictionary(b, dictionary, ["c"]).collect()
    assert encode.apply_dictionary(b, dictionary, ["c"], "null").where("c IS NULL").count() == 1


def test_names_with_dots_and_dashes(spark):
    df = spark.createDataFrame([("1", "?"), ("3", "2")], "`saw-tooth` string, `a.b` string")
    out = clean.impute_mean(clean.coerce_numeric(clean.sentinel_to_null(df), df.columns), df.columns)
    assert [tuple(r) for r in out.collect()] == [(1.0, 2.0), (3.0, 2.0)]
    roles = Roles(("saw-tooth", "a.b"), ("a.b",))
    assert clean.cast_roles(out, roles).first()["saw-tooth"] == "1.0"


def test_roles():
    roles = split_roles(["id", "b", "a"], ["b", "gone"], drop=["id"])
    assert (roles.continuous, roles.categorical, roles.features("b")) == (("b",), ("a",), ["a"])


def test_profile_text(spark):
    df = spark.createDataFrame([("1.0", 2.0), ("2.0", 4.0), ("1.0", 9.0)], "k string, x double")
    rows = {r["column"]: r["statistic"] for r in profile.profile_table([("t", df, Roles(("k", "x"), ("x",)))]).collect()}
    assert rows == {"k": "1.0 [2]", "x": "5.0 (3.6)"}


def test_older_result_files(spark, tmp_path):
    """Two runs of a published file of the older shape, cut to two measures, beside one of the present shape."""
    older = """{"run 0": {"cross": 1.0, "rbo": 0.75, "debug": {"cross": [1.0], "rbo": [1.0, 0.5]}},
 "run 1": {"cross": NaN, "rbo": 0.5, "debug": {"cross": [NaN], "rbo": [0.5, 0.5]}}}"""
    present = """{"run 0": {"T3": {"results": {"rbo": 0.25}, "true_score": [0.5, 0.25], "model_score": [0.25, 0.5],
 "true_score_rank": [1, 2], "model_score_rank": [2, 1], "true_score_rank_join": "12", "model_score_rank_join": "21"},
 "aggregated": {"rbo": 0.25}, "cross": {"real_synth": {"T3": [2.0, 1.0, 2.0]}, "synth_real": {"T3": [1.0, 1.0, 1.0]}, "aggregated": [0.6]}}}"""
    (tmp_path / "dt_2.json").write_text(older)
    (tmp_path / "rf_4.json").write_text(present)
    read = src.read_results_json(spark, str(tmp_path))
    keys = ["method", "dataset"]
    flat = {(r["method"], r["dataset"], r["run"], r["metric"], r["target"]): r["value"] for r in report.flatten_results(read, keys).collect()}
    assert flat[("dt", "2", "run 0", "rbo", None)] == 0.75 and np.isnan(flat[("dt", "2", "run 1", "cross", None)])
    assert flat[("rf", "4", "run 0", "rbo", "T3")] == 0.25 and flat[("rf", "4", "run 0", "ratio_rs_sr", None)] == 0.6
    assert len(flat) == 8
    lists = report.explode_lists(read, keys).where("metric = 'rbo'").orderBy("run", "pos").collect()
    assert [(r["run"], r["pos"], r["value"]) for r in lists] == [("run 0", 0, 1.0), ("run 0", 1, 0.5), ("run 1", 0, 0.5), ("run 1", 1, 0.5)]
    vectors = report.extract_vectors(read, keys).orderBy("pos").collect()
    assert [tuple(r)[4:] for r in vectors] == [(0, 0.5, 0.25, 1, 2, "12", "21"), (1, 0.25, 0.5, 2, 1, "12", "21")]


@pytest.mark.parametrize("text, message", [('{"run 0": {"T3": 1}}', "unknown shape"), ('{"run 0": {"rbo"', "no JSON document")])
def test_other_result_files_fail(spark, tmp_path, text, message):
    (tmp_path / "dt_2.json").write_text(text)
    with pytest.raises(Exception, match=message):
        src.read_results_json(spark, str(tmp_path)).collect()


def test_score_lists_and_vectors_survive_a_round_trip(spark, tmp_path):
    values = [("rf", "x", f"run {r:02}", m, p, p / 8 + r) for r in range(12) for m in ("rbo", "cross") for p in range(3)]
    lists = spark.createDataFrame(values, "method string, dataset string, run string, metric string, pos int, value double")
    src.write_results_json(src.nest_score_lists(lists), str(tmp_path / "older"))
    read = src.read_results_json(spark, str(tmp_path / "older"))
    assert sorted(tuple(r) for r in report.explode_lists(read, ["method", "dataset"]).collect()) == sorted(values)
    assert {r["value"] for r in report.flatten_results(read).where("run = 'run 03' AND metric = 'rbo'").collect()} == {3.125}

    scores = spark.createDataFrame([("rf", "x", "run 0", t, "rbo", 1.0) for t in "ab"], "method string, dataset string, run string, target string, metric string, value double")
    cross = spark.createDataFrame(
        [("rf", "x", "run 0", s, "a", 2.0, 1.0, 2.0) for s in ("real_synth", "synth_real")],
        "method string, dataset string, run string, type string, column string, ratio double, own double, other double",
    )
    cells = [("rf", "x", "run 0", "a", p, s, 1 / (p + 3), r, 12 - r) for p, s, r in ((2, 0.1, 2), (0, 1e-300, 11), (1, 0.7, 1))]
    vectors = spark.createDataFrame(
        cells, "method string, dataset string, run string, target string, pos int, score_a double, score_b double, rank_a int, rank_b int"
    )
    src.write_results_json(src.nest_results(scores, cross, vectors=vectors), str(tmp_path / "present"))
    got = report.extract_vectors(src.read_results_json(spark, str(tmp_path / "present"))).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("run 0", "a", i, s, b, r, k, "1112", "11110") for i, (_, _, _, _, _, s, b, r, k) in enumerate(sorted(cells, key=lambda c: c[4]))]


def test_box_stats_count_equal_values(spark):
    values = [1.0, 2.0, 2.0, 2.0, 3.0, 4.0, 100.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 5.0)], "g string, value double")
    rows = {r["g"]: r.asDict() for r in report.box_stats(df, ["g"]).collect()}
    assert rows["g"] == {"g": "g", "q1": 2.0, "median": 2.5, "q3": 28.0, "low": 1.0, "high": 4.0, "n_outside": 2}
    assert rows["h"] == {"g": "h", "q1": 5.0, "median": 5.0, "q3": 5.0, "low": 5.0, "high": 5.0, "n_outside": 0}


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_dictionaries_of_either_size_give_the_same_codes(spark, monkeypatch, sent):
    monkeypatch.setattr(encode, "SENT_BYTES", sent)
    df = spark.createDataFrame([("x", "1"), ("y", None), ("x", "0")], "c string, d string")
    dictionary = encode.fit_dictionary(df, ["c", "d"])
    assert dictionary.fits("c") == (sent > 0)
    assert sorted(map(str, map(tuple, encode.apply_dictionary(df, dictionary, ["c", "d"]).collect()))) == ["(0.0, 0.0)", "(0.0, 1.0)", "(1.0, None)"]
