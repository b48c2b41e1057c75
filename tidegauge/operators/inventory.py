"""Inventory states: shortage flags, snapshots, priorities, ranked rules and budgeted allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clean import first_match, ratio
from .aggregate import first_rows


def shortage_threshold(capacity: str, share: float = 0.1) -> Column:
    """ceil(share of capacity), 1 at least."""
    return F.ceil(F.greatest(F.col(capacity) * F.lit(share), F.lit(1.0))).cast("long")


def short(units: str, threshold: Column) -> Column:
    """Units at or under the threshold; unknown is not short."""
    return F.coalesce(F.col(units) <= threshold, F.lit(False))


def with_shortage_flags(df: DataFrame, capacity: str, stock: str, space: str, share: float = 0.1) -> DataFrame:
    """Fill rates and boolean stock_short and space_short; both null where capacity is null or not positive."""
    limit = shortage_threshold(capacity, share)
    known = F.col(capacity) > 0
    return df.withColumns(
        {
            "stock_rate": ratio(stock, capacity),
            "space_rate": ratio(space, capacity),
            "stock_short": F.when(known, short(stock, limit)),
            "space_short": F.when(known, short(space, limit)),
        }
    )


def inventory_snapshot(meta: DataFrame, status: DataFrame, key: str, capacity: str, stock: str, space: str, order: list, share: float = 0.1, spare: int = 20) -> DataFrame:
    """One row a key of `meta` (first in `order`) with its status: thresholds, flags, pressure and whether a status was found.

    A null capacity takes the median, or `spare` where all are null. Pressure is the share of the capacity (1 at least) that is not
    in stock. Rows of a null key match no status; has_status is whether the stock is known.
    """
    one = first_rows(meta, [key], order)
    median = one.agg(F.median(capacity).alias("_median"))
    found = status.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), stock, space)
    out = one.crossJoin(F.broadcast(median)).withColumn(capacity, F.coalesce(F.col(capacity), F.col("_median"), F.lit(spare))).drop("_median")
    out = out.join(found, out[key] == found["_key"], "left")
    limit = shortage_threshold(capacity, share)
    return out.withColumns(
        {
            "threshold": limit,
            "stock_short": short(stock, limit),
            "space_short": short(space, limit),
            "pressure": 1 - F.col(stock) / F.greatest(F.col(capacity), F.lit(1)),
            "has_status": F.col(stock).isNotNull(),
        }
    ).drop("_key")


def rebalancing(df: DataFrame, capacity: str, stock: str, space: str, share: float = 0.1, low: float = 0.2, high: float = 0.8, balanced: bool = False) -> DataFrame:
    """Rows that need action: issue, action, severity (six digits, half-even) and the signed change to a target fill.

    Each side's severity is the gap to the threshold as a share of it, plus what the side's fill rate lacks to 1. A stock gap that is at
    least as severe as the other side is a stock shortage (fill up to `low`); else a space gap is a space shortage (empty down to
    `high`); else the row is balanced, kept only on request, with a tenth of the larger distance of a fill rate from a half. A stock gap that the
    other side outweighs without a gap of its own is balanced. Rows without capacity, stock or space are left out.
    """
    limit = shortage_threshold(capacity, share)
    ok = F.col(capacity).isNotNull() & (F.col(capacity) > 0) & F.col(stock).isNotNull() & F.col(space).isNotNull()
    gap = lambda units: F.greatest(limit - F.col(units), F.lit(0))
    fill = lambda units: F.col(units) / F.col(capacity)
    severity = lambda units: gap(units) / limit + F.greatest(F.lit(0.0), 1 - fill(units))
    up = F.greatest(F.ceil(F.col(capacity) * F.lit(low)) - F.col(stock), F.lit(1)).cast("long")
    down = F.greatest(F.col(stock) - F.floor(F.col(capacity) * F.lit(high)), F.lit(1)).cast("long")
    is_stock = (gap(stock) > 0) & (severity(stock) >= severity(space))
    calm = F.greatest(F.abs(fill(stock) - 0.5), F.abs(fill(space) - 0.5)) * 0.1
    out = df.where(ok).withColumns({"threshold": limit, "issue": first_match([(is_stock, F.lit("stock_shortage")), (gap(space) > 0, F.lit("space_shortage"))], "balanced")})
    stock_issue, space_issue = F.col("issue") == "stock_shortage", F.col("issue") == "space_shortage"
    out = out.withColumns(
        {
            "action": first_match([(stock_issue, F.lit("send")), (space_issue, F.lit("remove"))], "monitor"),
            "severity": F.bround(first_match([(stock_issue, severity(stock)), (space_issue, severity(space))], calm), 6),
            "delta": first_match([(stock_issue, up), (space_issue, -down)], F.lit(0).cast("long")),
        }
    )
    return out if balanced else out.where("issue <> 'balanced'")


def ranked(df: DataFrame, order: list, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def severity_order(*tie: str) -> list:
    return [F.desc("severity"), F.desc(F.abs("delta")), *tie]


def top_global(df: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k most severe rows of all, ranked 1 to k; only k rows are gathered."""
    if k < 1:
        raise ValueError("k must be positive")
    return ranked(df.orderBy(*severity_order(*tie)).limit(k), severity_order(*tie))


def top_per_group(df: DataFrame, group: str, k: int, *tie: str) -> DataFrame:
    return ranked(df, severity_order(*tie), [group]).where(F.col("rank") <= k)


def top_balanced(df: DataFrame, group: str, k: int, *tie: str) -> DataFrame:
    """In each group the floor(k/2) most severe rows to send to, and k minus that many to remove from."""
    out = ranked(df, severity_order(*tie), [group, "action"], "action_rank")
    quota = F.when(F.col("action") == "send", k // 2).when(F.col("action") == "remove", k - k // 2).otherwise(0)
    return out.where(F.col("action_rank") <= quota)


def rule_precision(df: DataFrame, group: str, ks: list[int], stock_label: str, space_label: str, *tie: str) -> DataFrame:
    """(group, k, mode, predictions, hits, precision, and send and remove counts and hits) for global and balanced top-k of each group.

    A hit is a row whose next state bears out its issue; an unknown next state is a miss. Rows are ranked
    once, in both ways; only those within the largest k in either are counted, at every k.
    """
    hit = F.coalesce(F.when(F.col("issue") == "stock_shortage", F.col(stock_label)).otherwise(F.col(space_label)), F.lit(False))
    rows = ranked(ranked(df, severity_order(*tie), [group]), severity_order(*tie), [group, "action"], "action_rank").withColumn("hit", hit)
    most = max(ks)
    rows = rows.where((F.col("rank") <= most) | (F.col("action_rank") <= most - most // 2))
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mode")) for k in ks for m in ("global", "balanced")]))
    rows = rows.select(group, "rank", "action_rank", "action", "hit", cases.alias("c")).select("*", "c.k", "c.mode")
    quota = F.when(F.col("action") == "send", F.floor(F.col("k") / 2)).when(F.col("action") == "remove", F.col("k") - F.floor(F.col("k") / 2)).otherwise(0)
    taken = rows.where(F.when(F.col("mode") == "global", F.col("rank") <= F.col("k")).otherwise(F.col("action_rank") <= quota))
    by_action = [f(c).alias(f"{a}_{n}") for a in ("send", "remove") for n, f, c in (("count", F.count_if, F.col("action") == a), ("hits", F.count_if, (F.col("action") == a) & F.col("hit")))]
    counted = taken.groupBy(group, "k", "mode").agg(F.count("*").alias("predictions"), F.count_if("hit").alias("hits"), *by_action)
    return counted.withColumn("precision", F.col("hits") / F.col("predictions"))


def rule_summary(panel: DataFrame, per_group: DataFrame, group: str, stock_label: str, space_label: str, ks: list[int], least: int) -> DataFrame:
    """One row on a rule's evaluation: status against the least number of snapshots, coverage of labelled snapshots, and precision at each k.

    `panel` has all rows with their labels, `per_group` what rule_precision gives. Snapshots are counted in the whole panel; those with a
    label in rows that have either label; evaluated ones where the rule says something. At the largest k, each action's figures in
    both modes. A precision over nothing is null.
    """
    known = F.col(stock_label).isNotNull() | F.col(space_label).isNotNull()
    base = panel.agg(F.count_distinct(group).alias("snapshots"), F.count_distinct(F.when(known, F.col(group))).alias("label_snapshots"), F.count(stock_label).alias("label_rows"))
    most = max(ks)
    whole, top = F.col("mode") == "global", F.col("k") == most
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    parts = [F.count_distinct(F.when(whole, F.col(group))).alias("evaluated_snapshots")]
    for k in ks:
        at = whole & (F.col("k") == k)
        parts += [total("predictions", at).alias(f"predictions_at_{k}"), total("hits", at).alias(f"hits_at_{k}"), F.try_divide(total("hits", at), total("predictions", at)).alias(f"precision_at_{k}")]
    for name, mode in (("", whole & top), ("balanced_", ~whole & top)):
        for a in ("send", "remove"):
            n, hits = total(f"{a}_count", mode), total(f"{a}_hits", mode)
            parts += [n.alias(f"{name}{a}_count"), hits.alias(f"{name}{a}_hits"), F.try_divide(hits, n).alias(f"{name}{a}_precision")]
    parts += [F.try_divide(total("hits", ~whole & top), total("predictions", ~whole & top)).alias(f"balanced_precision_at_{most}")]
    one = base.crossJoin(F.broadcast(per_group.agg(*parts)))
    enough = F.col("snapshots") >= least
    return one.withColumns(
        {
            "coverage": F.col("evaluated_snapshots") / F.greatest(F.col("label_snapshots"), F.lit(1)),
            "status": F.when(enough & (F.col("evaluated_snapshots") > 0), "READY").otherwise("NOT_READY"),
            "evaluation": F.when(F.col("evaluated_snapshots") > 0, "EVALUATED").otherwise("NOT_EVALUATED"),
        }
    )


def micro_precision(per_group: DataFrame, group: str) -> DataFrame:
    """Hits over predictions, summed over groups."""
    return per_group.groupBy("k", "mode").agg(
        F.count_distinct(group).alias("groups"), F.sum("predictions").alias("predictions"), F.sum("hits").alias("hits"),
        (F.sum("hits") / F.sum("predictions")).alias("precision"),
    )


def allocate(buckets: DataFrame, key: str, target: str, priority: str, least_share: float = 0.35, budget_share: float = 0.82) -> DataFrame:
    """Units for each bucket under a budget, by priority: every bucket its minimum, then each up to its target in order.

    The minimum is floor(least_share of target), the budget budget_share of all targets or, if more, all minima. This solves the linear
    program that weighs unmet targets by priority and surplus lightly. Ties go by larger target, then key.
    """
    out = buckets.withColumn("least", F.floor(F.col(target) * F.lit(least_share)))
    every = Window.partitionBy()
    before = Window.orderBy(F.desc(priority), F.desc(target), key).rowsBetween(Window.unboundedPreceding, -1)
    want = F.col(target) - F.col("least")
    budget = F.greatest(F.sum("least").over(every).cast("double"), F.sum(target).over(every) * F.lit(budget_share))
    out = out.withColumns({"_spare": budget - F.sum("least").over(every), "_taken": F.coalesce(F.sum(want).over(before), F.lit(0))})
    extra = F.least(want.cast("double"), F.greatest(F.lit(0.0), F.col("_spare") - F.col("_taken")))
    out = out.withColumn("allocated", F.col("least") + extra)
    return out.withColumn("shortage", F.greatest(F.lit(0.0), F.col(target) - F.col("allocated"))).drop("_spare", "_taken")


def demand_targets(df: DataFrame, bucket: str, forecast: str, upper: str) -> DataFrame:
    """Of each bucket: mean and peak forecast, the median upper bound, and ceil(0.55 median + 0.25 peak) as its target."""
    out = df.groupBy(bucket).agg(F.avg(forecast).alias("mean_forecast"), F.max(forecast).alias("peak"), F.median(upper).alias("upper_median"), F.count("*").alias("hours"))
    return out.withColumn("target", F.ceil(0.55 * F.col("upper_median") + 0.25 * F.col("peak")).cast("long"))


def forecast_priority(day: DataFrame, entity: str, forecast: str, radius: float, live: DataFrame, capacity: str, short_flag: str, top: int = 12) -> DataFrame:
    """Entities by risk over the 24 hours of forecasts in `day`: the summed demand's upper bound over capacity, with a boost for those short now.

    The bound adds the radius of one hour times the root of 24. A capacity counts as 1 at least; without one there is no risk, and such
    come last. The buffer is a quarter of what the bound exceeds the capacity by, rounded up, and the boost is no part of it. `live` has
    one row an entity. Ties in risk go by entity.
    """
    total = day.groupBy(entity).agg(F.sum(forecast).alias("forecast_sum"), F.max(forecast).alias("peak"), F.count("*").alias("hours"))
    out = total.join(live, entity, "left").withColumn("upper", F.col("forecast_sum") + F.lit(radius) * F.sqrt(F.lit(24.0)))
    known = F.when(F.col(capacity).isNotNull(), F.greatest(F.col(capacity), F.lit(1.0)))
    out = out.withColumn("risk", F.col("upper") / known)
    over = F.when(F.col("risk").isNotNull(), F.greatest(F.col("risk") - 1, F.lit(0.0)))
    out = out.withColumn("buffer", F.ceil(over * F.col(capacity) * 0.25).cast("double"))
    boost = F.when(F.coalesce(F.col(short_flag), F.lit(False)), 0.75).otherwise(0.0)
    return out.withColumn("risk", F.col("risk") + boost).orderBy(F.desc_nulls_last("risk"), entity).limit(top)


def map_points(inventory: DataFrame, priority: DataFrame, key: str, lat: str, lon: str, order: list) -> DataFrame:
    """Places with both coordinates, with their priority (the last in `order` of a key) and a marker colour."""
    last = first_rows(priority.where(F.col(key).isNotNull()), [key], order)
    out = inventory.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).join(last, key, "left")
    issue = F.coalesce(F.nullif(F.col("issue"), F.lit("")), F.lit("balanced"))
    colour = first_match([(issue == "stock_shortage", F.lit("red")), (issue == "space_shortage", F.lit("blue"))], "green")
    return out.withColumns({"issue": issue, "colour": colour})
