"""Model operators against plain NumPy, ragged snapshot logs, and small helpers that no query calls."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import calendar as cal
from tidegauge.functions import clean
from tidegauge.operators import metrics, models, panels
from tidegauge.operators import temporal as tm
from tidegauge.sources import readers, sinks
from tidegauge.streaming import states


@pytest.fixture(scope="module")
def panel(spark):
    """400 rows at 100 times, a label that follows x1 and, less, the state now."""
    draw = np.random.default_rng(1)
    x, now = draw.normal(size=(400, 2)), draw.random(400) < 0.4
    y = draw.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.5 * x[:, 1] + now - 0.5)))
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(hours=k // 4), k % 4, float(x[k, 0]), float(x[k, 1]), bool(now[k]), bool(y[k]), float(3 * x[k, 0] + x[k, 1])) for k in range(400)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, unit int, x1 double, x2 double, now boolean, y boolean, v double").cache()


def test_logistic_matches_newton(panel):
    got = {r.id: r.score for r in models.logistic(panel, ["x1", "x2"], "y")(panel).select("id", "score").collect()}
    rows = sorted(panel.collect(), key=lambda r: r.id)
    x, y = np.array([[r.x1, r.x2] for r in rows]), np.array([r.y for r in rows], float)
    z = np.c_[np.ones(len(y)), (x - x.mean(0)) / x.std(0)]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag([0, 1, 1]), z.T @ (w * (p - y)) + np.r_[0, b[1:]])
    assert np.allclose([got[r.id] for r in rows], 1 / (1 + np.exp(-z @ b)), atol=1e-3)


def test_one_class_gives_its_constant(panel):
    assert {(r.score, r.predicted) for r in models.logistic(panel.where("y"), ["x1"], "y")(panel).select("score", "predicted").collect()} == {(1.0, True)}


def test_ridge_of_two_features_matches_normal_equations(panel):
    got = {r.id: r.prediction for r in models.ridge(panel, ["x1", "x2"], "v", 5.0)(panel).collect()}
    rows = panel.collect()
    x, v = np.array([[r.x1, r.x2] for r in rows]), np.array([r.v for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z + 5 * np.eye(2), z.T @ (v - v.mean()))
    assert np.allclose([got[r.id] for r in rows], v.mean() + z @ b, atol=1e-6)


def test_boosted_trees_learn(panel):
    out = models.boosted(panel, ["x1", "x2"], "v", trees=10, depth=3, rate=0.3)(panel)
    mae, base = out.agg(F.avg(F.abs(F.col("v") - F.col("prediction")))).first()[0], panel.agg(F.avg(F.abs(F.col("v")))).first()[0]
    assert mae < 0.4 * base


def test_suite_ablation_and_audit(panel):
    train, test = panel.where("id < 300"), panel.where("id >= 300")
    rows = models.suite(train, test, ["x1", "x2"], "y", "now", ["unit"]).collect()
    assert {r.model for r in rows} == {"persistence", "profile", "logistic"} and rows[0].model == "logistic" and all(r.rows == 100 for r in rows)
    kept = models.ablation(train, test, {"both": ["x1", "x2"], "weak": ["x2"]}, "y").collect()
    assert [r.model for r in kept] == ["both", "weak"]
    audit = models.rolling_audit(panel, "ts", tm.distinct_times(panel, "ts"), ["x1"], "y", "now", ["unit"], folds=2)
    assert audit.groupBy("fold").count().count() == 2
    best = panels.fold_best(audit).first()
    assert best.folds == 2 and best.best_worst <= best.best_mean
    assert models.rolling_audit(panel, "ts", [1, 2, 3], ["x1"], "y", "now", ["unit"]) is None


@pytest.mark.parametrize("shuffled", [100_000, 60])
def test_permutation_importance_ranks_features(panel, monkeypatch, shuffled):
    monkeypatch.setattr(models, "SHUFFLED", shuffled)
    model = models.ridge(panel, ["x1", "x2"], "v", 1.0)
    rise = {r.feature: r.importance for r in models.permutation_importance(panel.select("id", "x1", "x2", "v"), model, ["x1", "x2"], "v", "id", repeats=2).collect()}
    assert rise["x1"] > rise["x2"] > 0


def test_permutation_importance_is_what_swapping_by_hand_gives(spark, panel):
    """The donors found again by their hashes; names that the operator uses inside are the caller's."""
    df = panel.where("id < 60").select("id", "x1", "x2", "v", *[F.lit(7).alias(c) for c in ("_row", "_group", "_at", "_given", "_case", "feature")])
    model = models.ridge(panel, ["x1", "x2"], "v", 1.0)
    got = {r.feature: (r.importance, r.spread) for r in models.permutation_importance(df, model, ["x1", "x2"], "v", "id", repeats=3, seed=9).collect()}
    mae = lambda frame: frame.agg(F.avg(F.abs(F.col("v") - F.col("prediction")))).first()[0]
    rows, base = sorted(df.select("id", "x1", "x2", "v").collect()), mae(model(df))
    for f in ("x1", "x2"):
        rises = []
        for r in range(3):
            hashes = {h.id: h.h for h in df.select("id", F.xxhash64(F.lit(9 + r), "id").alias("h")).collect()}
            other = sorted(rows, key=lambda x: hashes[x.id])
            swapped = [(x.id, o.x1 if f == "x1" else x.x1, o.x2 if f == "x2" else x.x2, x.v) for x, o in zip(rows, other)]
            rises.append(mae(model(spark.createDataFrame(swapped, "id long, x1 double, x2 double, v double"))) - base)
        assert np.allclose(got[f], (np.mean(rises), np.std(rises)))


def test_calibration_uses_no_test_rows(panel):
    parts = panels.calibration_splits(panel, "ts")
    ends = {r.part: (r.a, r.b) for r in parts.groupBy("part").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert ends["fit"][1] < ends["calibration"][0] and ends["calibration"][1] < ends["test"][0]
    fit, calibration = parts.where("part = 'fit'"), parts.where("part = 'calibration'")
    scored = models.calibrated(fit, calibration, parts.where("part = 'test'"), ["x1", "x2"], "y", metrics.threshold_grid())
    chosen = scored.select("threshold").distinct().collect()
    assert len(chosen) == 1 and 0.05 <= chosen[0].threshold <= 0.95
    assert scored.where("predicted <> (score >= threshold)").count() == 0 and scored.count() == 100
    assert panels.calibration_splits(panel.where("id < 8"), "ts").count() == 0


def test_bootstrap_interval_holds_the_mean(panel):
    df = panel.withColumn("p", F.col("v") + F.col("x2"))
    mae = df.agg(F.avg(F.abs("x2"))).first()[0]
    one, two = metrics.bootstrap_mae(df, "v", "p", "id", 400).first(), metrics.bootstrap_mae(df.repartition(7), "v", "p", "id", 400).first()
    assert one.low < mae < one.high and one.high - one.low < 0.3 * mae and np.allclose(one, two)


@pytest.mark.parametrize("leaf", [1 << 16, 37])
def test_resamples_are_exact_and_like_those_of_numpy(panel, monkeypatch, leaf):
    monkeypatch.setattr(metrics, "LEAF", leaf)
    df = panel.withColumn("p", F.col("v") + F.floor(F.col("x2") * 4)).unionByName(panel.where("id < 40").withColumn("p", F.col("v") + 9))
    draws = metrics.resampled_errors(df, "v", "p", "id", 300)
    assert {r.n for r in draws.groupBy("rep").agg(F.sum("w").alias("n")).collect()} == {440}
    assert draws.select("rep").distinct().count() == 300 and (draws.groupBy("rep").count().first()["count"] > 1) == (leaf < 400)
    errors = np.array([abs(r.v - r.p) for r in df.collect()])
    rng = np.random.default_rng(1)
    want = np.percentile([rng.choice(errors, len(errors)).mean() for _ in range(4000)], [2.5, 97.5])
    got = metrics.bootstrap_mae(df, "v", "p", "id", 3000).first()
    width = want[1] - want[0]
    assert abs(got.low - want[0]) < 0.08 * width and abs(got.high - want[1]) < 0.08 * width
    none = metrics.bootstrap_mae(df.where("id < 0"), "v", "p", "id", 10).first()
    assert none.low is None and none.high is None


def test_models_are_saved_and_loaded(panel, tmp_path):
    fit = models.ridge(panel, ["x1"], "v", 1.0)
    models.save(fit, f"{tmp_path}/m")
    again = models.load(f"{tmp_path}/m")
    assert fit(panel).select("id", "prediction").exceptAll(again(panel).select("id", "prediction")).count() == 0


def test_classifiers_and_constants_are_saved_and_loaded(panel, tmp_path):
    for name, fit in (("logistic", models.logistic(panel, ["x1", "x2"], "y")), ("constant", models.logistic(panel.where("y"), ["x1"], "y"))):
        models.save(fit, f"{tmp_path}/{name}")
        again = models.load(f"{tmp_path}/{name}")
        columns = ["id", "score", "predicted"]
        assert fit(panel).select(columns).exceptAll(again(panel).select(columns)).count() == 0


def test_night_threshold_is_chosen_on_night_rows(panel):
    parts = panels.calibration_splits(panel, "ts").withColumn("hr", F.hour("ts"))
    fit, calibration, test = (parts.where(f"part = '{p}'") for p in ("fit", "calibration", "test"))
    got = {(r.hr <= 5, r.threshold) for r in models.calibrated(fit, calibration, test, ["x1", "x2"], "y", metrics.threshold_grid(), "hr").select("hr", "threshold").distinct().collect()}
    rows = models.logistic(fit, ["x1", "x2"], "y")(calibration).select("y", "score", "hr").collect()

    def best(rows):
        def rank(t):
            tp, said, pos = sum(r.y and r.score >= t for r in rows), sum(r.score >= t for r in rows), sum(r.y for r in rows)
            return -(2 * tp / (said + pos) if said + pos else 0), -(tp / said if said else 0), abs(t - 0.5), t

        return min(metrics.threshold_grid(), key=rank)

    assert got == {(True, best([r for r in rows if r.hr <= 5])), (False, best(rows))}


def test_cutoffs_are_resolved():
    at = dt.datetime(2026, 7, 13, 5, 15, 3, tzinfo=dt.timezone.utc)
    assert cal.resolve_cutoff(at, {}).isoformat() == "2026-07-13T14:15:03+09:00"
    assert cal.resolve_cutoff(None, {"snapshot_cutoff_at": "2026-07-13T14:15:03+09:00"}) == at
    assert [cal.resolve_cutoff(None, x) for x in ({}, {"snapshot_cutoff_at": None}, {"snapshot_cutoff_at": "soon"}, {"snapshot_cutoff_at": "2026-07-13T14:15:03"})] == [None] * 4


def test_snapshot_log_is_one_scan_of_files_written_by_many_tasks(spark, tmp_path, monkeypatch):
    names = ["station_name", "gbfs_station_id", "capacity", "num_bikes_available"]
    want, tasks, plain = set(), [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda df, n, *by: tasks.append(n) or plain(df, n, *by))
    for i, own in enumerate([names, names[::-1], names[1:3], [names[3], "other", names[0]]]):
        rows = [(f"2024010{i + 1}_0000{k % 40:02d}", *[f"{c},{k}" for c in own]) for k in range(80)]
        assert sinks.to_snapshots(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["stamp", *own])), str(tmp_path), "stamp") == 40
        want |= {(r[0], *[dict(zip(own, r[1:])).get(c) for c in names]) for r in rows}
    got = readers.snapshot_log(spark, str(tmp_path))
    assert {tuple(r) for r in got.select(F.date_format("captured_at", "yyyyMMdd_HHmmss"), *names).collect()} == want and got.count() == 320
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1 and min(tasks) >= spark.sparkContext.defaultParallelism


def test_snapshot_log_of_ragged_files(spark, tmp_path):
    write = lambda stamp, text: (tmp_path / f"{stamp}_inventory_snapshot.csv").write_text(text, encoding="utf-8")
    write("20240101_000000", "﻿gbfs_station_id,capacity,num_bikes_available,current_bike_shortage\ng1,10,3,True\n\ng2,x,,no\n")
    write("20240101_010000", 'num_bikes_available,station_name,gbfs_station_id,extra\n4,"A, ""b""",g1,z\n5,B,,z\n')
    write("20240102_000000", "gbfs_station_id,capacity\ng1,10\n")
    (tmp_path / "notes_inventory_snapshot.csv").write_text("gbfs_station_id\ng9\n")
    raw = readers.snapshot_log(spark, str(tmp_path), until="20240101_235959")
    got = sorted((str(r.captured_at), r.gbfs_station_id, r.capacity, r.num_bikes_available, r.station_name, r.num_docks_available) for r in readers.snapshot_history(raw).collect())
    first, second = "2024-01-01 00:00:00", "2024-01-01 01:00:00"
    assert got == [(first, "g1", 10, 3, None, None), (first, "g2", None, None, None, None), (second, "g1", None, 4, 'A, "b"', None)]
    assert readers.snapshot_log(spark, str(tmp_path)).count() == 5
    flags = {r.gbfs_station_id: r.current_bike_shortage for r in readers.snapshot_history(raw).where("capacity is not null or num_bikes_available is null").collect()}
    assert flags == {"g1": True, "g2": False}


def test_odd_snapshot_fields_are_read_as_duckdb_reads_them(spark, tmp_path):
    import duckdb

    folder = tmp_path / "logs of [a] *day"
    folder.mkdir()
    texts = [
        "station_short_name,station_name,gbfs_station_id,capacity\n,Name A,g1,10\nB,,g2,\n,,g3,\n",
        'gbfs_station_id,station_name,capacity\ng4,"two\nlines, and ""quotes""",7\ng5,"",8\n',
        "capacity,gbfs_station_id,station_name,station_short_name\n1,g6,x,\n,g7,, spaced \n",
    ]
    for k, text in enumerate(texts):
        (folder / f"20240101_0{k}0000_inventory_snapshot.csv").write_text(text, encoding="utf-8")
    names = ["station_short_name", "station_name", "gbfs_station_id", "capacity"]
    got = readers.snapshot_log(spark, str(folder).replace("[", "\\[").replace("]", "\\]").replace("*", "\\*")).select(*names)
    paths = [str(p) for p in sorted(folder.iterdir())]
    want = [r for p in paths for r in duckdb.read_csv(p.replace("[", "[[]").replace("*", "[*]"), header=True, all_varchar=True, sep=",", quotechar='"', escapechar='"').project(",".join(n if n in open(p).readline() else f"NULL AS {n}" for n in names)).fetchall()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert readers.snapshot_log(spark, str(tmp_path)).count() == 0


def test_pages_are_read_to_the_last_one(spark, tmp_path):
    rows = [{"stationId": f"ST-{k}", "rackTotCnt": "5", "parkingBikeTotCnt": "2"} for k in range(5)]
    asked = []

    def page(start: int, end: int) -> dict:
        asked.append((start, end))
        return {"rentBikeStatus": {"list_total_count": 5, "RESULT": {"CODE": "INFO-000", "MESSAGE": "ok"}, "row": rows[start - 1 : end]}}

    summary = readers.landed_pages(page, str(tmp_path / "pages"), 2, most=9)
    assert asked == [(1, 2), (3, 4), (5, 6)] and summary == {"pages": 3, "complete": True}
    stock = readers.captured(spark, str(tmp_path / "pages"), "2026-01-01T00:00:00+09:00", 2)
    assert stock.count() == 5 and {r.docks_available for r in stock.collect()} == {3}
    assert readers.landed_pages(page, str(tmp_path / "few"), 2, most=2) == {"pages": 2, "complete": False}
    with pytest.raises(ValueError, match="not complete"):
        readers.captured(spark, str(tmp_path / "few"), "2026-01-01T00:00:00+09:00", 2)
    with pytest.raises(ValueError, match="INFO-200"):
        readers.landed_pages(lambda a, b: {"rentBikeStatus": {"RESULT": {"CODE": "INFO-200"}}}, str(tmp_path / "bad"), 2)


def test_acquired_falls_back_with_its_reason(spark, tmp_path):
    def broken():
        raise OSError("no network")

    df, about = readers.acquired(spark, broken, lambda: readers.synthetic_demand(spark, 3))
    assert df.count() == 72 and about == {"source": "synthetic", "reason": "OSError: no network"}
    (tmp_path / "hour.csv").write_text("instant,dteday,hr,cnt\n2,2011-01-01,1,5\n1,2011-01-01,0,3\n")
    df, about = readers.acquired(spark, lambda: f"{tmp_path}/hour.csv", lambda: None)
    assert about["source"] == "file" and [(str(r.datetime), int(r.cnt)) for r in df.orderBy("datetime").collect()] == [("2011-01-01 00:00:00", 3), ("2011-01-01 01:00:00", 5)]
    assert "instant" not in df.columns
    df, about = readers.acquired(spark, lambda: f"{tmp_path}/none.csv", lambda: readers.synthetic_trips(spark, 2, 3), readers.trips)
    assert about["source"] == "synthetic" and "PATH_NOT_FOUND" in about["reason"] and df.count() > 0
    copies = [readers.stamped_copy(f"{tmp_path}/hour.csv", f"{tmp_path}/raw", s) for s in ("20240101_000000", "20240101_010000")]
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["20240101_000000_hour.csv", "20240101_010000_hour.csv", "hour.csv"] and copies[1].endswith("010000_hour.csv")


def test_small_readers_and_sinks(spark, tmp_path):
    (tmp_path / "env").write_text("# c\nexport KEY='v'\n\nB = 2\nnothing\n")
    assert readers.settings(f"{tmp_path}/env") == {"KEY": "v", "B": "2"} and readers.settings(f"{tmp_path}/none") == {}
    (tmp_path / "file.csv").write_text("a,b\n1,2\n3,4\n")
    assert readers.fetched((tmp_path / "file.csv").as_uri(), f"{tmp_path}/sub/got.csv") == f"{tmp_path}/sub/got.csv"
    assert [r.a for r in readers.head(spark, f"{tmp_path}/sub/got.csv", 1).collect()] == ["1"]
    assert readers.synthetic_stations(spark, 4).count() == 4
    df = spark.range(10).withColumn("d", F.col("id") % 2)
    sinks.to_parquet(df, f"{tmp_path}/p", ["d"])
    assert spark.read.parquet(f"{tmp_path}/p").where("d = 1").count() == 5
    sinks.sample_to_csv(df, f"{tmp_path}/s", [F.desc("id")], 3)
    assert sorted(r.id for r in spark.read.csv(f"{tmp_path}/s", header=True).collect()) == ["7", "8", "9"]
    text = sinks.markdown_table(spark.createDataFrame([("a", 1.5), ("bb", None)], "name string, v double"), digits=2)
    assert text.split("\n") == ["| name | v    |", "|------|------|", "| a    | 1.50 |", "| bb   |      |"]
    sinks.report(f"{tmp_path}/r.md", "Title", {"rows": 2}, {"Table": df.where("id < 1")})
    report = (tmp_path / "r.md").read_text()
    assert report.startswith("# Title\n") and "- rows: 2" in report and "## Table" in report and "| 0" in report


def test_small_functions(spark):
    element = "struct<a:int>"
    df = spark.createDataFrame([('{"a": 1}',), ('[{"a": 1}, {"a": 2}]',), ("7",), (None,)], "t string")
    assert [None if r.x is None else [e.a for e in r.x] for r in df.select(clean.one_or_many("t", element).alias("x")).collect()] == [[1], [1, 2], None, None]
    one = spark.createDataFrame([("20240101_010203",)], "s string").select(cal.parse_stamp("s").cast("timestamp_ntz").alias("t"))
    assert str(one.first().t) == "2024-01-01 01:02:03" and one.select(cal.iso_in_zone("t", "America/New_York").alias("i")).first().i == "2023-12-31T20:02:03-05:00"
    assert one.select(cal.iso_seconds("t").alias("i")).first().i.startswith("2024-01-01T01:02:03")
    with pytest.raises(ValueError):
        cal.cutoff("2024-01-01T00:00:00")
    assert cal.cutoff("2024-01-01T00:00:00+09:00").utcoffset() == dt.timedelta(hours=9)
    schema = spark.createDataFrame([], "a int, b string").schema
    assert clean.ensure_columns(spark.createDataFrame([("1",)], "a string"), schema).collect() == [(1, None)]


def test_trailing_counts_stream(spark, tmp_path):
    rows = [("u", dt.datetime(2024, 1, 1, h)) for h in (0, 1, 1, 5)] + [("u", dt.datetime(2024, 1, 3))]
    spark.createDataFrame(rows, "user string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = states.trailing_counts(states.file_stream(spark, f"{tmp_path}/in", "user string, ts timestamp"), "user", "ts", hours=3)
    q = stream.writeStream.format("memory").queryName("trailing").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.until.hour: r.n for r in spark.table("trailing").where("day(until) = 1").collect()}
    assert got == {1: 1, 2: 3, 3: 3, 4: 2, 6: 1, 7: 1, 8: 1}
    assert json.loads(spark.table("trailing").limit(1).toJSON().first())["user"] == "u"
