"""Aggregations: quantiles, histograms, resampling, first rows, segments and column profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import day_floor
from ..sources.sinks import kept_rows
from .ordered import Ordered


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k keys with most rows; ties by key. Null keys don't count."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(k)


def only_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def quantile(value: str, q: float) -> Column:
    """Exact, linear between ranks."""
    return F.percentile(value, F.lit(q))


#: Different values of a group up to which they are put in order in one row, and ranges that more are cut into at a time.
IN_ORDER, RANGES = 10_000, 64


def exact_quantiles(df: DataFrame, value: str, by: list[str], levels: dict[str, float], weight: str | None = None, kinds: int | None = None) -> DataFrame:
    """(by, a column a level): exact quantiles of each group as doubles, linear between ranks, nulls left out; groups without values have no row.

    A group's different values are counted first, evenly by group and value. Groups of up to IN_ORDER of them are put in order; larger ones
    are cut into ranges, their counts tell which range a rank is in, and only those ranges are looked into further, all groups side
    by side. No buffer grows with a group. With `weight` a row counts that many times. `kinds` is a bound on a group's different values, if the
    caller has one.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull()).select(key.alias("_key"), F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    cells = rows.groupBy("_key", "v").agg(F.sum("w").alias("w"))
    sizes = cells.groupBy("_key").agg(F.sum("w").alias("n"))
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.explode(F.array_distinct(F.array(*[f(at(q)) for q in levels.values() for f in (F.floor, F.ceil)])))
    targets = sizes.select("_key", ranks.alias("r")).select("_key", "r", F.col("_key").alias("_of"), F.col("r").alias("_rank"))
    found = _selected(cells, targets, kinds).groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "v"))).alias("_values"))
    out = sizes.join(found, F.col("_key") == F.col("_of"))
    low, high = (lambda q, f=f: F.element_at("_values", f(at(q))) for f in (F.floor, F.ceil))
    between = lambda q: low(q) + (high(q) - low(q)) * (at(q) - F.floor(at(q)))
    return out.select(*[F.col(f"_key.`{c}`").alias(c) for c in by], *[F.when(low(q) == high(q), low(q)).otherwise(between(q)).alias(n) for n, q in levels.items()])


def _selected(cells: DataFrame, targets: DataFrame, kinds: int | None = None) -> DataFrame:
    """(_of, _rank, v): of each target (_key, r, _of, _rank) the value at rank r, from 0, of its key's cells (_key, v, w) in order."""
    sizes = cells.groupBy("_key").agg(F.count("*").alias("k"))
    large = sizes.where(F.col("k") > IN_ORDER).select("_key")
    some = (kinds is None or kinds > IN_ORDER) and large.limit(1).count() > 0
    small = cells.join(large, "_key", "left_anti") if some else cells
    lists = small.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("cells"))
    start = F.struct(F.col("r").alias("left"), F.lit(None).cast("double").alias("v"))
    walk = F.aggregate("cells", start, lambda s, x: F.when(s["left"] < 0, s).otherwise(F.struct((s["left"] - x["w"]).alias("left"), x["v"].alias("v"))), lambda s: s["v"])
    out = targets.join(lists, "_key").select("_of", "_rank", walk.alias("v"))
    if not some:
        return out
    grid = [k / RANGES for k in range(RANGES + 1)]
    edges = cells.join(large, "_key", "left_semi").groupBy("_key").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", grid))).alias("edges"))
    placed = kept_rows(cells.join(edges, "_key").select("_key", "v", "w", F.size(F.filter("edges", lambda e: e <= F.col("v"))).alias("_part")))
    counts = placed.groupBy("_key", "_part").agg(F.sum("w").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto)
    hit = targets.join(counts, "_key").where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))
    inner = F.struct("_key", "_part").alias("_key")
    deeper = hit.select(inner, (F.col("r") - F.col("upto") + F.col("n")).alias("r"), "_of", "_rank")
    within = placed.join(hit.select("_key", "_part").distinct(), ["_key", "_part"], "left_semi").select(inner, "v", "w")
    return out.unionByName(_selected(within, deeper))


def higher_quantile(df: DataFrame, value: str, by: list[str], level: float, name: str = "quantile") -> DataFrame:
    """The value at rank ceil(level * (n - 1)), counted from 0: the upper of the two that a linear quantile lies between."""
    if not by:
        return _whole_quantile(df, value, level, name)
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).select(*by, value)
    ranked = ranked.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.ceil(F.lit(float(level)) * (F.col("_n") - 1))).select(*by, F.col(value).alias(name))


def _whole_quantile(df: DataFrame, value: str, level: float, name: str) -> DataFrame:
    """As higher_quantile over all rows: approximate quantiles bracket the rank, and only the rows between them are put in order."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    near = [max(0.0, level - 0.002), min(1.0, level + 0.002)]
    n, (low, high) = rows.agg(F.count("*"), F.coalesce(F.percentile_approx("v", near, 10_000), F.array(F.lit(None), F.lit(None)))).first()
    rank = math.ceil(level * (n - 1)) if n else 0
    below, inside = rows.agg(F.count_if(F.col("v") < F.lit(low)), F.count_if(F.col("v").between(low, high))).first() if n else (0, 0)
    if not below <= rank < below + inside:  # not between them: order all
        low, high, below = None, None, 0
    some = rows if low is None else rows.where(F.col("v").between(low, high))
    counts = some.groupBy("v").agg(F.count("*").alias("n"))
    upto = Ordered(counts, ["v"]).running({"upto": "n"})
    return upto.where(F.col("upto") > rank - below).agg(F.min("v").alias(name)).where(F.col(name).isNotNull())


def first_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def pivot_mean(df: DataFrame, row: Column, column: Column, value: str, values: list) -> DataFrame:
    """Mean of a value by row and column; the column's values are listed, so no extra pass finds them."""
    return df.withColumn("_column", column).groupBy(row.alias("row")).pivot("_column", values).agg(F.avg(value))


def daily_sum(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(day, total): every day from first to last, 0 where nothing happened."""
    days = df.groupBy(day_floor(ts).alias("day")).agg(F.sum(value).alias("total"))
    ends = df.agg(day_floor(F.min(ts)).alias("a"), day_floor(F.max(ts)).alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("total", F.lit(0.0)).alias("total"))


def hour_shares(df: DataFrame, ts: str, distinct_times: bool = False) -> DataFrame:
    """(hour, share) for all 24 hours, of rows or of distinct times."""
    rows = df.select(ts).where(F.col(ts).isNotNull())
    counts = (rows.distinct() if distinct_times else rows).groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    joined = hours.join(F.broadcast(counts), "hour", "left").crossJoin(F.broadcast(total))
    return joined.select("hour", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"))


def by_segment(df: DataFrame, segments: dict[str, Column], *aggs: Column, keys: list[str] | None = None) -> DataFrame:
    """Aggregates for overlapping segments in one pass: a row counts in each segment whose condition holds. Empty segments have no row."""
    named = F.array(*[F.when(cond, F.lit(name)) for name, cond in segments.items()])
    return df.withColumn("segment", F.explode(F.array_compact(named))).groupBy(*(keys or []), "segment").agg(*aggs)


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, missing, example): nulls and the smallest value as text, for each column, in one pass."""
    parts = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.count_if(F.col(f.name).isNull()).alias("missing"), F.min(F.col(f.name).cast("string")).alias("example"),
        )
        for f in df.schema
    ]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def counts_map(df: DataFrame, key: str) -> DataFrame:
    """One row with a map from each value to its count."""
    counts = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull())
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias("counts"))
