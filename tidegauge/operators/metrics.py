"""Forecast and classifier metrics, thresholds, intervals and bootstrap, each as one aggregate plan."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import kept_rows
from .aggregate import higher_quantile
from .ordered import Ordered


def regression_metrics(y: str, p: str) -> list[Column]:
    """mae, rmse, mape, smape, wape (in percent, each over a denominator of 1 at least) and r2."""
    e = F.col(y) - F.col(p)
    least = lambda c: F.greatest(c, F.lit(1))
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.abs(e) / least(F.abs(y)))).alias("mape"),
        (100 * F.avg(2 * F.abs(e) / least(F.abs(y) + F.abs(p)))).alias("smape"),
        (100 * F.sum(F.abs(e)) / least(F.sum(F.abs(y)))).alias("wape"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
    ]


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(y: str, p: str) -> list[Column]:
    """rows, accuracy, precision, recall and f1 of boolean columns; a ratio over nothing is 0."""
    tp, fp, fn = (F.count_if(c) for c in (F.col(y) & F.col(p), ~F.col(y) & F.col(p), F.col(y) & ~F.col(p)))
    return [
        F.count("*").alias("rows"),
        F.avg((F.col(y) == F.col(p)).cast("int")).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def brier(y: str, score: str) -> Column:
    """Mean squared error of a probability; 1 where only one class is there."""
    label = F.col(y).cast("int")
    return F.when(F.min(label) < F.max(label), F.avg(F.pow(F.col(score) - label, 2))).otherwise(1.0).alias("brier")


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: the sum over distinct scores, from the top, of recall gained times precision; 0 where only one class is there.

    Rows are summed by score first, so the running sums see a row for each distinct score.
    """
    steps = df.groupBy(score).agg(F.sum(F.col(y).cast("int")).alias("pos"), F.count("*").alias("n"))
    run = Ordered(steps.withColumn("_down", -F.col(score)), ["_down"]).running({"tp": "pos", "seen": "n"})
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.sum("pos"), F.lit(0))
    one = (F.sum("pos") > 0) & (F.sum("pos") < F.sum("n"))
    return run.agg(F.when(one, ap).otherwise(0.0).alias("average_precision"))


def conformal_level(n: int, alpha: float) -> float:
    return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)


def conformal_intervals(df: DataFrame, y: str, p: str, calibration: Column, alpha: float = 0.1) -> DataFrame:
    """The other rows with lower (0 at least), upper and covered; the radius is the calibration residuals' upper quantile."""
    residuals = kept_rows(df.where(calibration).select(F.abs(F.col(y) - F.col(p)).alias("r")).where("r is not null"))
    n = residuals.count()
    if not n:
        raise ValueError("no calibration rows")
    radius = higher_quantile(residuals, "r", [], conformal_level(n, alpha), "radius")
    out = df.where(~calibration).crossJoin(F.broadcast(radius))
    out = out.withColumns({"lower": F.greatest(F.lit(0.0), F.col(p) - F.col("radius")), "upper": F.col(p) + F.col("radius")})
    return out.withColumn("covered", F.col(y).between(F.col("lower"), F.col("upper")))


def threshold_grid(start: float = 0.05, stop: float = 0.95, step: float = 0.025) -> list[float]:
    n = round((stop - start) / step)
    return [round(start + k * step, 3) for k in range(n + 1)]


def threshold_metrics(df: DataFrame, y: str, score: str, grid: list[float], keys: list[str] | None = None) -> DataFrame:
    """Precision, recall and f1 at every threshold (score >= t) in one pass: a row is counted in its grid bin, and bins are summed from the top."""
    keys = keys or []
    bin_ = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col(score)))
    bins = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("pos"))
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(grid)]))
    met = bins.select("*", each.alias("g")).select(*keys, "g.threshold", (F.col("bin") >= F.col("g.k")).alias("p"), "n", "pos")
    tp, said, all_pos = F.sum(F.when(F.col("p"), F.col("pos")).otherwise(0)), F.sum(F.when(F.col("p"), F.col("n")).otherwise(0)), F.sum("pos")
    return met.groupBy(*keys, "threshold").agg(
        _share(tp, said).alias("precision"), _share(tp, all_pos).alias("recall"), _share(2 * tp, said + all_pos).alias("f1")
    )


def best_threshold(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of each key the threshold of highest f1, then precision, then nearest to 0.5, then lowest."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.desc("f1"), F.desc("precision"), F.abs(F.col("threshold") - 0.5), "threshold")
    return metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def night_thresholds(calibration: DataFrame, y: str, score: str, hour: str, grid: list[float]) -> DataFrame:
    """One row (day, night): the best thresholds over all rows, and over those of the hours 0 to 5. One pass; no row if either has no rows."""
    parts = F.explode(F.array_compact(F.array(F.lit("day"), F.when(F.col(hour).between(0, 5), "night")))).alias("_part")
    best = best_threshold(threshold_metrics(calibration.select(y, score, parts), y, score, grid, ["_part"]), ["_part"])
    of = lambda part: F.max(F.when(F.col("_part") == part, F.col("threshold"))).alias(part)
    return best.agg(of("day"), of("night")).where("day is not null and night is not null")


def by_hour_threshold(df: DataFrame, score: str, hour: str, chosen: DataFrame) -> DataFrame:
    """df with threshold (night's in the hours 0 to 5, else day's, of a row that night_thresholds gives) and predicted."""
    out = df.crossJoin(F.broadcast(chosen.toDF("_day", "_night")))
    out = out.withColumn("threshold", F.when(F.col(hour).between(0, 5), F.col("_night")).otherwise(F.col("_day"))).drop("_day", "_night")
    return out.withColumn("predicted", F.col(score) >= F.col("threshold"))


def class_balance(df: DataFrame, y: str, keys: list[str]) -> DataFrame:
    pos, neg = F.count_if(F.col(y)), F.count_if(~F.col(y))
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), pos.alias("positives"), neg.alias("negatives"), F.avg(F.col(y).cast("int")).alias("rate"),
        (pos / F.greatest(neg, F.lit(1))).alias("pos_neg_ratio"),
    )


def hour_diagnostics(df: DataFrame, ts: str, y: str, now: str, policies: dict[str, str]) -> DataFrame:
    """By hour: rows, label rate, share of rows that change state, and precision, recall and f1 of each policy."""
    out = [F.count("*").alias("rows"), F.avg(F.col(y).cast("int")).alias("rate"), F.avg((F.col(now) != F.col(y)).cast("int")).alias("transition_rate")]
    for name, p in policies.items():
        rows, accuracy, *rest = classification_metrics(y, p)
        out += [c.alias(f"{name}_{k}") for c, k in zip(rest, ("precision", "recall", "f1"))]
    return df.groupBy(F.hour(ts).alias("hour")).agg(*out)


#: Rows that are drawn from at a time.
LEAF = 1 << 16


def resampled_errors(df: DataFrame, y: str, p: str, key: str, reps: int = 1000, seed: int = 17) -> DataFrame:
    """(rep, e, w) a leaf and resample: the sum of the absolute errors drawn and how many, of exact resamples with replacement: in each, w adds up to the number of rows.

    Rows are dealt into leaves by a hash of key and error; equal ones are counted first. How many of a resample's draws fall into a leaf is
    found by halving: at each step down to the leaf a binomial draw, seeded by the step, splits them between the halves, so all leaves
    agree without a word between them. Inside a leaf positions are drawn. The same for any partitioning of df.
    """
    rows = df.select(F.abs(F.col(y) - F.col(p)).cast("double").alias("e"), F.xxhash64(F.lit(seed), F.col(key), F.abs(F.col(y) - F.col(p)).cast("double")).alias("h")).where("e is not null")
    cells = rows.groupBy("h", "e").agg(F.count("*").alias("n"))
    total, kinds = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    leaves = max(1, math.ceil(kinds / LEAF))
    dealt = cells.withColumn("leaf", F.pmod("h", F.lit(leaves)).cast("int"))
    sizes = np.zeros(leaves, np.int64)
    for r in dealt.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    upto = np.r_[0, np.cumsum(sizes)]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        leaf, low, high = key[0].as_py(), 0, leaves
        draws = np.full(reps, total, np.int64)
        while high - low > 1:
            mid = (low + high) // 2
            share = (upto[mid] - upto[low]) / max(1, upto[high] - upto[low])
            left = np.random.default_rng([seed, low, high]).binomial(draws, share)
            draws, low, high = (left, low, mid) if leaf < mid else (draws - left, mid, high)
        order = np.lexsort((t.column("e").to_numpy(), t.column("h").to_numpy()))
        e, ends = t.column("e").to_numpy()[order], np.cumsum(t.column("n").to_numpy()[order])
        draw, sums = np.random.default_rng([seed, leaf, leaves, 1]), np.empty(reps)
        for k, m in enumerate(draws.tolist()):
            sums[k] = sum(e[np.searchsorted(ends, draw.integers(0, ends[-1], min(m - at, 1 << 20)), "right")].sum() for at in range(0, m, 1 << 20))
        return pa.table({"rep": np.arange(reps), "e": sums, "w": draws})

    return dealt.groupBy("leaf").applyInArrow(run, "rep long, e double, w long")


def bootstrap_mae(df: DataFrame, y: str, p: str, key: str, reps: int = 1000, seed: int = 17, levels=(0.025, 0.975)) -> DataFrame:
    """One row (low, high): a percentile interval of the mean absolute error over resamples with replacement; nulls where there are no errors."""
    maes = resampled_errors(df, y, p, key, reps, seed).groupBy("rep").agg((F.sum("e") / F.sum("w")).alias("mae"))
    return maes.agg(*[F.percentile("mae", F.lit(q)).alias(n) for q, n in zip(levels, ("low", "high"))])
