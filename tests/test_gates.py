"""Gates, series summaries and case filters on worked examples."""

from pyspark.sql import functions as F

from lexforge.operators import gates
from lexforge.sources import records


def test_series_summary_worked_example(spark):
    rows = [("a", 100), ("a", 250), ("a", 400), ("a", None), ("b", None), (None, 7)]
    got = {r.k: (r["count"], r.mean, r.total, r.p50, r.p95) for r in gates.series_summary(spark.createDataFrame(rows, "k string, v long"), ["k"], "v").collect()}
    assert got["a"] == (3, 250.0, 750, 250, 250) and "b" not in got


def test_gates_thresholds(spark):
    rows = [("p95_latency", 100.0, 107.5), ("p99_latency", 0.0, 5.0), ("mean_cost", 1.0, None)]
    got = {(r.measure, r.phase): (r.rise, r.blocked) for r in gates.gates(spark.createDataFrame(rows, "measure string, baseline double, candidate double")).collect()}
    assert len(got) == 9
    assert [got["p95_latency", p] for p in ("merge", "staging", "ramp")] == [(0.075, False), (0.075, True), (0.075, False)]
    assert got["p99_latency", "ramp"] == (None, False) == got["mean_cost", "merge"]


def test_top_failing_is_stable_on_first_appearance(spark):
    rows = [("s", 0, "z", False), ("s", 1, "a", False), ("s", 2, "m", True), ("s", 3, "m", False), ("s", 4, "q", True)]
    d = spark.createDataFrame(rows, "source_path string, case_pos int, family string, passed boolean")
    assert [(r.family, r.failed) for r in gates.top_failing(d, "family", [F.col("source_path"), F.col("case_pos")]).collect()] == [("z", 1), ("a", 1), ("m", 1), ("q", 0)]


def test_filter_cases(spark):
    d = spark.createDataFrame([("s", i, f) for i, f in enumerate(["a", None, "b", ""])], "source_path string, case_pos int, family string")
    places = lambda *x, **y: sorted(r.case_pos for r in gates.filter_cases(d, *x, **y).collect())
    assert (places(), places(["unknown"]), places(["a", "b"]), places(limit=2), places(limit=0), places(limit=-3)) == ([0, 1, 2, 3], [1, 3], [0, 2], [0, 1], [], [0, 1, 2, 3])


def test_sustained_needs_windows_in_a_row(spark):
    d = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, None)], "day int, bad boolean").withColumn("all", F.lit(0))
    assert [r.sustained for r in gates.carried_over(d, "all", ["day"], F.col("bad")).orderBy("day").collect()] == [False, True, False, False, False]


def test_runs_with_cases_and_the_newest_strictly(spark, tmp_path):
    import os

    folder = tmp_path / "runs"
    folder.mkdir()
    for i, (name, text) in enumerate({"a": '{"run_id": "a", "cases": [{"case_id": "x"}]}', "b": '{"run_id": "b", "cases": []}', "c": '{"run_id": "c"}', "d": '{"run_id": "d", "cases": {"case_id": "y"}}', "e": "[1]"}.items()):
        (folder / f"{name}.json").write_text(text)
        os.utime(folder / f"{name}.json", (i + 1, i + 1))
    assert sorted(r.run_id for r in records.read_trace_runs(spark, str(folder)).collect()) == ["a", "d"]
    assert records.newest(spark, str(folder)).first().body == "[1]"
    try:
        records.newest(spark, str(folder), strict=True).collect()
        raise AssertionError("a run that is no object must fail")
    except Exception as e:  # noqa: BLE001
        assert "no JSON object" in str(e)
