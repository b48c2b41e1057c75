"""Exact quantiles by group against NumPy, where groups are cut into ranges once, many times, or not at all."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidegauge.operators import aggregate as agg
from tidegauge.operators import drift, profile

LEVELS = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93, "top": 1.0}


def rows(n=3000, seed=2):
    draw = random.Random(seed)
    kinds = {"even": lambda: draw.random(), "tied": lambda: float(draw.choice([1, 1, 1, 1, 2, 3])), "wide": lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-9, 9), None: lambda: draw.gauss(0, 1)}
    out = [(g, f()) for g, f in kinds.items() for _ in range(n)] + [("one", 7.0), ("none", None), ("two", 1.0), ("two", 2.0), ("even", None)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("in_order,ranges", [(10_000, 64), (200, 8), (3, 4), (1, 2)])
def test_quantiles_match_numpy(spark, monkeypatch, in_order, ranges):
    monkeypatch.setattr(agg, "IN_ORDER", in_order)
    monkeypatch.setattr(agg, "RANGES", ranges)
    data = rows(3000 if ranges > 4 else 60)
    got = {r.g: r for r in agg.exact_quantiles(spark.createDataFrame(data, "g string, v double"), "v", ["g"], LEVELS).collect()}
    groups = {g: [v for k, v in data if k == g and v is not None] for g in {k for k, _ in data}}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, r in got.items():
        assert np.allclose([r[k] for k in LEVELS], np.quantile(groups[g], list(LEVELS.values())), rtol=1e-12, atol=0)


def test_weights_repeat_rows_and_empty_frames_have_none(spark, monkeypatch):
    monkeypatch.setattr(agg, "IN_ORDER", 5)
    monkeypatch.setattr(agg, "RANGES", 3)
    data = [("a", float(k % 17), k % 4) for k in range(100)]
    got = agg.exact_quantiles(spark.createDataFrame(data, "g string, v double, w int").where("w > 0"), "v", [], LEVELS, "w").first()
    assert np.allclose([got[k] for k in LEVELS], np.quantile([v for _, v, w in data for _ in range(w)], list(LEVELS.values())))
    assert agg.exact_quantiles(spark.createDataFrame([], "g string, v double"), "v", ["g"], LEVELS).collect() == []


def test_profiles_and_stability_keep_their_values_in_ranges(spark, monkeypatch):
    draw = random.Random(5)
    data = [(draw.randrange(4), draw.randrange(3), draw.randrange(40)) for _ in range(900)]
    train = spark.createDataFrame(data, "a int, b int, n int")
    target = spark.createDataFrame([(a, b) for a in (0, 3, 9) for b in (0, 7)], "a int, b int")
    e = spark.createDataFrame([(k, draw.gauss(0, 1) + (k > 500)) for k in range(1000)], "k int, v double")
    run = lambda: (sorted((r.a, r.b, r.profile) for r in profile.profile_chain(train, target, [["a", "b"], ["a"]], "n").collect()), drift.psi(e, "v", e.k < 500).first().psi)
    whole = run()
    monkeypatch.setattr(agg, "IN_ORDER", 6)
    monkeypatch.setattr(agg, "RANGES", 4)
    cut = run()
    assert whole[0] == cut[0] and np.isclose(whole[1], cut[1], rtol=1e-12)
    median = lambda keep: float(np.median([n for a, b, n in data if keep(a, b)]))
    assert whole[0] == sorted((a, b, median(lambda x, y: (x, y) == (a, b)) if a < 4 and b < 3 else median(lambda x, y: x == a) if a < 4 else median(lambda x, y: True)) for a in (0, 3, 9) for b in (0, 7))
