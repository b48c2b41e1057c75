"""Operators over one order against plain Python, with ranges shorter than the windows that reach over them, ties of nulls, and empty frames."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ordered
from tidegauge.operators import temporal as tm
from tidegauge.operators.ordered import Ordered


@pytest.fixture(autouse=True)
def short_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "LEAST_ROWS", 1)


def series(n, seed=1, gaps=0.4):
    draw = random.Random(seed)
    keys = draw.sample(range(10 * n), n)
    return [(k, None if draw.random() < gaps else draw.randint(0, 99)) for k in keys]


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (7, 5), (40, 16), (40, 64), (500, 8)])
def test_all_operators_match_plain_python(spark, n, parts):
    rows = series(n)
    df = spark.createDataFrame(rows, "k long, v long")
    lined = sorted(rows)
    o = Ordered(df, ["k"], parts)
    if n >= 40:
        assert len(o.spans) > 3
    assert {(r.k, r.row) for r in o.numbered().collect()} == {(k, i + 1) for i, (k, _) in enumerate(lined)}
    upto = {k: sum(v or 0 for _, v in lined[: i + 1]) for i, (k, _) in enumerate(lined)}
    assert {r.k: r.s for r in o.running({"s": "v"}).collect()} == upto
    window = 9
    got = o.windowed({"lag": lambda w: F.lag("v", 3).over(w), "lead": lambda w: F.lead("v", 4).over(w), "sum": lambda w: F.sum("v").over(w.rowsBetween(-window, 2))}, before=window, after=4)
    assert got.columns == ["k", "v", "lag", "lead", "sum"]
    want = {}
    for i, (k, _) in enumerate(lined):
        near = [v for _, v in lined[max(0, i - window) : i + 3] if v is not None]
        want[k] = (lined[i - 3][1] if i >= 3 else None, lined[i + 4][1] if i + 4 < n else None, sum(near) if near else None)
    assert {r.k: (r.lag, r.lead, r.sum) for r in got.collect()} == want
    held = {}
    for i, (k, _) in enumerate(lined):
        back = [v for _, v in lined[: i + 1] if v is not None]
        on = [v for _, v in lined[i:] if v is not None]
        held[k] = back[-1] if back else on[0] if on else None
    assert {r.k: r.v for r in o.filled(["v"]).collect()} == held


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "double", "decimal(12,3)", "string", "binary", "int"])
def test_keys_of_any_type(spark, kind):
    base = spark.range(300).selectExpr("(id * 7919) % 300 as i")
    at = {"timestamp_ntz": "timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,cast(i as int))", "timestamp": "timestamp '2024-03-30' + make_interval(0,0,0,0,cast(i as int))", "date": "date_add(date '2024-01-01', cast(i as int))",
          "string": "lpad(cast(i as string), 5, 'é')", "binary": "cast(lpad(cast(i as string), 5, '0') as binary)"}.get(kind, f"cast(i / 3.0 - 40 as {kind})")
    df = base.selectExpr("i", f"case when i = 0 then null else {at} end as at")
    o = Ordered(df, ["at", "i"], 16)
    assert len(o.spans) > 8
    got = [r.i for r in sorted(o.numbered().collect(), key=lambda r: r.row)]
    assert got == [r.i for r in df.orderBy("at", "i").collect()]


def test_no_exchange_of_all_rows_to_one_task(spark):
    df = spark.createDataFrame(series(300), "k long, v long")
    o = Ordered(df, ["k"], 8)
    frames = [o.numbered(), o.running({"s": "v"}), o.windowed({"l": lambda w: F.lag("v").over(w)}, 1), o.filled(["v"]), tm.row_fold_of(df, ["k"]), tm.series_features(df, "v", [1], {3: 1}, ["k"])]
    for f in frames:
        assert "SinglePartition" not in f._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 3, 4, 11, 60])
def test_splits_and_folds_match_lists(spark, n):
    df = spark.createDataFrame([(t,) for t in list(range(n)) * 2 + [None]], "at long")
    times = list(range(n))
    cut = tm.temporal_cut(times, 0.25)
    got = {(r.at, r.split) for r in tm.temporal_split(df.where("at is not null"), "at", 0.25).collect()}
    assert got == (set() if cut is None else {(t, "train" if t <= cut else "test") for t in times})
    assert sorted(tuple(r) for r in tm.fold_bounds(df, "at", 3).collect()) == tm.rolling_origin_folds(times, 3)
    if n >= 4:
        named = {r.at: r.split for r in tm.chronological_split(df.where("at is not null"), "at").collect()}
        assert named == {t: "train" if t + 1 <= max(int(n * 0.7), 1) else "valid" if t + 1 <= max(int(n * 0.85), 1) else "test" for t in times}
