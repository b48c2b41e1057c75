"""Drift between a reference cohort and a later one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import exact_quantiles, hour_shares


def psi(df: DataFrame, value: str, reference: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """One row: the population stability index of the rows that are not reference against those that are.

    Bins are the reference's quantiles, equal edges merged, the outer ones open; shares are `floor` at
    least. Fewer than three edges give 0; an empty side gives null.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), reference.alias("ref"))
    qs = {f"q{k}": k / bins for k in range(bins + 1)}
    found = exact_quantiles(rows.where("ref"), "v", [], qs).agg(*[F.max(q).alias(q) for q in qs])
    edges = found.select(F.array_sort(F.array_distinct(F.array_compact(F.array(*qs)))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    cut = rows.crossJoin(F.broadcast(edges)).select("ref", F.size("edges").alias("k"), F.size(F.filter(inner, lambda e: e <= F.col("v"))).alias("bin"))
    counts = cut.groupBy("bin").agg(F.count_if("ref").alias("a"), F.count_if(~F.col("ref")).alias("b"), F.max("k").alias("k"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.max("k").alias("edges"))
    spine = total.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("edges") - 2, F.lit(0)))).alias("bin"))
    share = lambda n, t: F.greatest(F.coalesce(F.try_divide(F.coalesce(n, F.lit(0)), t), F.lit(0.0)), F.lit(floor))
    both = spine.join(F.broadcast(counts.drop("k")), "bin", "left").select("edges", "ta", "tb", share("a", F.col("ta")).alias("p"), share("b", F.col("tb")).alias("q"))
    index = F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))
    empty = (F.max("ta") == 0) | (F.max("tb") == 0)
    return both.agg(F.when(empty, None).when(F.max("edges") < 3, 0.0).otherwise(index).alias("psi"))


def hour_distance(reference: DataFrame, other: DataFrame, ts: str, distinct_times: bool = False) -> DataFrame:
    """One row: the total-variation distance of two histograms over the hours of the day, of rows or of distinct times."""
    a = hour_shares(reference, ts, distinct_times)
    b = hour_shares(other, ts, distinct_times).withColumnRenamed("share", "other")
    return a.join(b, "hour").agg((0.5 * F.sum(F.abs(F.col("share") - F.col("other")))).alias("hour_distance"))


def membership_rate(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: the share of rows whose key occurs in `known`."""
    ids = known.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()
    return df.join(ids, df[key] == ids["_k"], "left").agg(F.avg(F.col("_k").isNotNull().cast("int")).alias("membership_rate"))


def rate_difference(df: DataFrame, y: str, reference: Column) -> Column:
    rate = lambda c: F.avg(F.when(c, F.col(y).cast("int")))
    return F.abs(rate(reference) - rate(~reference))


def checks(values: DataFrame, limits: dict[str, tuple[float, str]], bad: str = "FAIL") -> DataFrame:
    """(check, value, limit, direction, status) for a one-row frame of values; null and NaN never pass."""
    rows = [
        F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value"), F.lit(float(at)).alias("limit"), F.lit(way).alias("direction"))
        for n, (at, way) in limits.items()
    ]
    value, limit = F.col("value"), F.col("limit")
    good = value.isNotNull() & ~F.isnan(value) & F.when(F.col("direction") == "max", value <= limit).otherwise(value >= limit)
    return values.select(F.inline(F.array(*rows))).withColumn("status", F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise(bad))


LIMITS = {"rate_difference": (0.1, "max"), "psi": (0.25, "max"), "hour_distance": (0.2, "max"), "membership_rate": (0.95, "min")}


def drift_table(
    df: DataFrame, reference: Column, ts: str, entity: str, value: str, y: str, distinct_times: bool = False, limits: dict | None = None, bad: str = "FAIL"
) -> DataFrame:
    """Four checks of the rows that are not reference against those that are: label rate, value distribution, hours, known entities."""
    old, new = df.where(reference), df.where(~reference)
    one = df.agg(rate_difference(df, y, reference).alias("rate_difference"))
    for part in (psi(df, value, reference), hour_distance(old, new, ts, distinct_times), membership_rate(new, old, entity)):
        one = one.crossJoin(F.broadcast(part))
    return checks(one, limits or LIMITS, bad)
