"""Operators over time: spines, lags, fills, next-state labels, splits and folds.

What is in one order over all rows (no `by`) goes through `ordered`, which puts it in ranges of that order; `order` is then column names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import minutes_between
from .ordered import Ordered


def time_spine(df: DataFrame, ts: str, step: str = "interval 1 hour") -> DataFrame:
    """One row for each step from the least to the greatest `ts`."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(step))).alias(ts))


def dense_spine(df: DataFrame, entity: str, ts: str, step: str = "interval 1 hour") -> DataFrame:
    """Every entity at every step. Steps are made inside each entity's row, so nothing but the two bounds is broadcast."""
    ends = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    ids = df.where(F.col(entity).isNotNull()).select(entity).distinct()
    return ids.crossJoin(F.broadcast(ends)).select(entity, F.explode(F.sequence("_a", "_b", F.expr(step))).alias(ts))


def onto_spine(spine: DataFrame, counts: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """counts at every point of the spine, `fill` where there are none."""
    return spine.join(counts, keys, "left").fillna(fill)


def _lag(value: str, n: int):
    return lambda w: F.lag(value, n).over(w)


def _trailing(value: str, rows: int, least: int | None):
    def make(w):
        w = w.rowsBetween(-rows, -1)
        return F.when(F.count(value).over(w) >= (rows if least is None else least), F.avg(value).over(w))

    return make


def series_features(df: DataFrame, value: str, steps: list[int], rows: dict[int, int | None], order: list, by: list[str] | None = None) -> DataFrame:
    """lag_<n> and trailing_<n> columns in one go: values n rows before, and means of the n rows before, this one excluded, null with fewer than `rows[n]` of them (None: all)."""
    new = {f"lag_{n}": _lag(value, n) for n in steps} | {f"trailing_{n}": _trailing(value, n, least) for n, least in rows.items()}
    return _over(df, new, max([*steps, *rows], default=0), order, by)


def _over(df: DataFrame, new: dict, before: int, order: list, by: list[str] | None) -> DataFrame:
    if not by:
        return Ordered(df, order).windowed(new, before)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({name: make(w) for name, make in new.items()})


def lags(df: DataFrame, value: str, steps: list[int], order: list, by: list[str] | None = None, prefix: str = "lag_") -> DataFrame:
    """Values some rows before; without `by` the series is one sequence."""
    return _over(df, {f"{prefix}{n}": _lag(value, n) for n in steps}, max(steps), order, by)


def trailing_mean(df: DataFrame, value: str, rows: int, order: list, by: list[str] | None = None, least: int | None = None, name: str | None = None) -> DataFrame:
    """Mean of the `rows` rows before, this one excluded; null with fewer than `least` (by default all) of them."""
    return _over(df, {name or f"trailing_{rows}": _trailing(value, rows, least)}, rows, order, by)


def filled(df: DataFrame, columns: list[str], order: list, by: list[str] | None = None) -> DataFrame:
    """Nulls take the last value before them, or else the first after."""
    if not by:
        return Ordered(df, order).filled(columns)
    w = Window.partitionBy(*by).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns})


def next_state(df: DataFrame, entity: str, ts: str, states: list[str], tolerance: float | None = 90.0, tie: list[str] | None = None) -> DataFrame:
    """Each row with its entity's next time, the gap in minutes, and next_<state>: null at the last row or past the tolerance."""
    w = Window.partitionBy(entity).orderBy(ts, *(tie or []))
    out = df.withColumn("next_ts", F.lead(ts).over(w)).withColumns({f"next_{s}": F.lead(s).over(w) for s in states})
    out = out.withColumn("gap_minutes", minutes_between(ts, "next_ts"))
    if tolerance is None:
        return out
    return out.withColumns({f"next_{s}": F.when(F.col("gap_minutes") <= tolerance, F.col(f"next_{s}")) for s in states})


def _times(df: DataFrame, at: str) -> tuple[DataFrame, int]:
    """(at, row) of the distinct times numbered in order, and how many there are."""
    times = Ordered(df.select(at).where(F.col(at).isNotNull()).distinct(), [at])
    return times.numbered("row"), times.total


def chronological_split(df: DataFrame, at: str, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """split: train, valid or test by the distinct values of `at` in order.

    The last training value is number int(n * train) and the last validation value number
    int(n * valid), counted from 1, products in double precision. Only the two cut values reach the rows.
    """
    times, n = _times(df, at)
    cut = lambda share: F.max(F.when(F.col("row") == max(math.floor(n * share), 1), F.col(at)))
    cuts = times.agg(cut(train).alias("_train"), cut(valid).alias("_valid"))
    name = F.when(F.col(at) <= F.col("_train"), "train").when(F.col(at) <= F.col("_valid"), "valid").otherwise("test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", name).drop("_train", "_valid")


def distinct_times(df: DataFrame, at: str) -> list:
    """The distinct values of `at` in order, on the driver: for snapshot times, few by nature. What works at any number of them takes the frame."""
    return [r[0] for r in df.select(at).where(F.col(at).isNotNull()).distinct().orderBy(at).collect()]


def chronological_cut(df: DataFrame, at: str, last: float) -> DataFrame:
    """One row (cut): the last of the distinct times that are not among the final share `last`; no row with fewer than four times. Both sides keep at least one time."""
    times, n = _times(df, at)
    size = min(max(int(n * (1 - last)), 1), n - 1)
    return times.where((F.col("row") == size) & F.lit(n >= 4)).select(F.col(at).alias("cut"))


def temporal_cut(times: list, test_fraction: float):
    """The last training time, or None for fewer than four times; both sides keep at least one."""
    n = len(times)
    if n < 4:
        return None
    return times[min(max(int(n * (1 - test_fraction)), 1), n - 1) - 1]


def temporal_split(df: DataFrame, at: str, test_fraction: float = 0.25) -> DataFrame:
    """split: train up to the cut, test after it; no rows with fewer than four distinct times."""
    out = df.crossJoin(F.broadcast(chronological_cut(df, at, test_fraction).withColumnRenamed("cut", "_cut")))
    return out.withColumn("split", F.when(F.col(at) <= F.col("_cut"), "train").otherwise("test")).drop("_cut")


def fold_places(n: int, folds: int = 3, min_train: float = 0.5) -> list[tuple[int, int, int]]:
    """(fold, number of the last training time, number of the last test time) among n times: training expands, test windows follow each other, the last takes the rest."""
    if n < folds + 4:
        return []
    first = max(1, math.floor(n * min_train))
    size = max(1, (n - first) // folds)
    ends = [(k + 1, first + k * size, n if k == folds - 1 else min(n, first + (k + 1) * size)) for k in range(folds)]
    return [(k, a, b) for k, a, b in ends if a < n and b > a]


def rolling_origin_folds(times: list, folds: int = 3, min_train: float = 0.5) -> list[tuple[int, object, object]]:
    """(fold, last training time, last test time) of times in order."""
    return [(k, times[a - 1], times[b - 1]) for k, a, b in fold_places(len(times), folds, min_train)]


def fold_bounds(df: DataFrame, at: str, folds: int = 3, min_train: float = 0.5) -> DataFrame:
    """(fold, train_end, test_end) of the frame's distinct times, a row a fold; none with too few times. The times stay where they are."""
    times, n = _times(df, at)
    places = df.sparkSession.createDataFrame(fold_places(n, folds, min_train), "fold int, a long, b long")
    met = lambda place, name: F.broadcast(places.select("fold", place)).join(times, F.col(place) == F.col("row")).select("fold", F.col(at).alias(name))
    return met("a", "train_end").join(met("b", "test_end"), "fold")


def in_fold(df: DataFrame, at: str, fold: tuple) -> DataFrame:
    """Rows of a fold with split train or test."""
    _, train_end, test_end = fold
    return df.where(F.col(at) <= F.lit(test_end)).withColumn("split", F.when(F.col(at) <= F.lit(train_end), "train").otherwise("test"))


def row_folds(df: DataFrame, order: list, folds: int = 5) -> DataFrame:
    """(fold, train_rows, test_rows) of expanding folds by row number: each tests n // (folds + 1) rows, the last ones."""
    n = df.agg(F.count("*").alias("n"))
    size = F.floor(F.col("n") / (folds + 1))
    k = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    return k.select("fold", (F.col("n") - (folds + 1 - F.col("fold")) * size).alias("train_rows"), size.alias("test_rows"))


def row_fold_of(df: DataFrame, order: list, folds: int = 5) -> DataFrame:
    """test_fold: the fold that tests a row, 0 for rows only trained on."""
    rows = Ordered(df, order)
    size = rows.total // (folds + 1)
    lead = rows.total - folds * size
    fold = F.when(F.col("_row") > lead, F.floor((F.col("_row") - lead - 1) / max(size, 1)) + 1).otherwise(0).cast("int")
    return rows.numbered("_row").withColumn("test_fold", fold).drop("_row")


def latest(df: DataFrame, entity: str, ts: str, tie: Column | str | None = None) -> DataFrame:
    """The last row of each entity."""
    w = Window.partitionBy(entity).orderBy(F.desc(ts), *([tie] if tie is not None else []))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_hours(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """Rows of the last `hours` hours, the latest included."""
    top = df.agg(F.max(ts).alias("_top"))
    return df.crossJoin(F.broadcast(top)).where(F.col(ts) >= F.col("_top") - F.expr(f"interval {hours - 1} hours")).drop("_top")
