"""Profiles: medians and rates by key, looked up from the finest level that has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept_rows
from .aggregate import exact_quantiles


def profile_chain(train: DataFrame, target: DataFrame, levels: list[list[str]], value: str, name: str = "profile") -> DataFrame:
    """target with the training median of `value` at the first of `levels` that has its keys, else over all.

    Values are counted once by all keys, in one scan of train whose counts are kept in the shared folder; each level's medians, exact
    ones, come of those counts and are joined on its keys.
    """
    every = list(dict.fromkeys(k for keys in levels for k in keys))
    counts = kept_rows(train.groupBy(*every, value).agg(F.count("*").alias("_n")))
    kinds, out = counts.select(value).distinct().count(), target
    for k, keys in enumerate(levels):
        out = out.join(exact_quantiles(counts, value, keys, {f"_p{k}": 0.5}, "_n", kinds), keys, "left")
    everywhere = exact_quantiles(counts, value, [], {"_all": 0.5}, "_n", kinds).agg(F.max("_all").alias("_all"))
    out = out.crossJoin(F.broadcast(everywhere))
    found = [f"_p{k}" for k in range(len(levels))]
    return out.withColumn(name, F.coalesce(*found, "_all")).drop(*found, "_all")


def profile_rate(train: DataFrame, target: DataFrame, keys: list[str], y: str) -> DataFrame:
    """target with rate (the training mean of a boolean by keys, else over all), the decision threshold and predicted.

    The threshold is the overall rate held between 0.1 and 0.5.
    """
    rates = train.groupBy(*keys).agg(F.avg(F.col(y).cast("int")).alias("_rate"))
    overall = train.agg(F.avg(F.col(y).cast("int")).alias("_all"))
    out = target.join(rates, keys, "left").crossJoin(F.broadcast(overall))
    out = out.withColumns({"rate": F.coalesce("_rate", "_all"), "threshold": F.least(F.lit(0.5), F.greatest(F.lit(0.1), F.col("_all")))})
    return out.withColumn("predicted", F.col("rate") >= F.col("threshold")).drop("_rate", "_all")
