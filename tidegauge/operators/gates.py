"""Contract checks, summaries and gates: tables of what holds, with evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clean import in_range, matches_kind, safe_str


@dataclass(frozen=True)
class FieldRule:
    """A field that must be there and read as int, float or str, within low and high if given."""

    field: str
    kind: str
    low: float | None = None
    high: float | None = None


def contract_issues(df: DataFrame, key: Column | str, rules: list[FieldRule]) -> DataFrame:
    """(row_key, field, issue): missing, wrong_type or out_of_range, for each rule that a row breaks."""
    found = []
    for r in rules:
        value = F.col(r.field)
        bad = F.when(safe_str(value).isNull(), "missing").when(~matches_kind(value, r.kind), "wrong_type")
        if r.low is not None:
            bad = bad.when(~in_range(value, r.low, r.high), "out_of_range")
        found.append(F.struct(F.lit(r.field).alias("field"), bad.alias("issue")))
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.alias("row_key"), F.inline(F.filter(F.array(*found), lambda s: s["issue"].isNotNull())))


def reported(issues: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` of each kind of issue: a bounded report."""
    w = Window.partitionBy("issue").orderBy("field", "row_key")
    return issues.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def inventory_summary(df: DataFrame, key: str, columns: list[str], min_rows: int = 1) -> DataFrame:
    """One row: rows, distinct and repeated keys, filled values and total of each column, errors and ok."""
    out = df.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), (F.count(key) - F.count_distinct(key)).alias("repeated"),
        *[F.count(c).alias(f"{c}_filled") for c in columns], *[F.sum(c).alias(f"{c}_total") for c in columns],
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("rows") < min_rows, "too_few_rows"),
            F.when(F.col("repeated") > 0, "repeated_keys"),
            *[F.when(F.col(f"{c}_filled") < F.col("rows"), f"missing_{c}") for c in columns],
        )
    )
    return out.withColumn("errors", F.array_join(errors, ",")).withColumn("ok", F.col("errors") == "")


def page_summary(pages: DataFrame) -> DataFrame:
    """One row over (page, rows, ok, page_size): pages, rows, whether all are ok and whether the last one was short."""
    last = F.max_by(F.col("rows") < F.col("page_size"), "page")
    return pages.agg(
        F.count("*").alias("pages"), F.sum("rows").alias("rows"), F.every("ok").alias("all_ok"),
        F.when(~F.every("ok"), "error").when(last, "last_page").otherwise("page_limit").alias("stopped_by"),
    )


def readiness(df: DataFrame, ts: str, entity: str, label: str, target_days: float = 14.0, per_day: int = 24, needed: float = 0.8, states: list[str] | None = None) -> DataFrame:
    """One row on a labelled history: span, snapshots against the number needed, labels, their rate, coverage (1 at most), what is still to come, ready and why.

    `states` are boolean columns whose rates are added. A history without rows is not ready, as it has no snapshots.
    """
    target = int(target_days * per_day)
    least = int(target * needed)
    span = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / F.lit(86400e6)
    out = df.agg(
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), span.alias("span_days"), F.count_distinct(ts).alias("snapshots"),
        F.count_distinct(entity).alias("entities"), F.count("*").alias("rows"), F.count(label).alias("labels"), F.avg(F.col(label).cast("int")).alias("label_rate"),
        *[F.avg(F.col(s).cast("int")).alias(f"{s}_rate") for s in states or []],
    )
    ready = F.coalesce((F.col("snapshots") >= least) & (F.col("span_days") >= target_days) & (F.col("labels") > 0), F.lit(False))
    return out.withColumns(
        {
            "needed_snapshots": F.lit(least),
            "remaining_snapshots": F.greatest(F.lit(least) - F.col("snapshots"), F.lit(0)),
            "coverage": F.least(F.col("snapshots") / F.lit(max(target, 1)), F.lit(1.0)),
            "earliest_ready_at": F.col("first_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(target_days * 86400.0).cast("decimal(18,6)")),
            "ready": ready,
            "reason": F.when(F.col("snapshots") == 0, "no snapshots").when(ready, "ready").otherwise("waiting for more snapshots"),
        }
    )


def gate_table(metrics: DataFrame, gates: list[tuple[str, Column, str, str]]) -> DataFrame:
    """(gate, passed, evidence, threshold) from a one-row frame; a condition over nulls has not passed."""
    rows = [
        F.struct(F.lit(name).alias("gate"), F.coalesce(cond, F.lit(False)).alias("passed"), F.col(evidence).cast("string").alias("evidence"), F.lit(limit).alias("threshold"))
        for name, cond, evidence, limit in gates
    ]
    return metrics.select(F.inline(F.array(*rows)))


def gate_decision(gates: DataFrame, yes: str = "GO", no: str = "NO_GO") -> DataFrame:
    """One row: all_passed, the failed gates in order, and the decision."""
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",")
    return gates.agg(F.every("passed").alias("all_passed"), failed.alias("failed")).withColumn("decision", F.when(F.col("all_passed"), yes).otherwise(no))


def not_ready(spark, reason: str) -> DataFrame:
    """The one-row status that stands in for results that can't be had yet."""
    return spark.createDataFrame([("NOT_READY", reason)], "status string, reason string")


def status(one_row: DataFrame, needs: list[tuple[Column, str]]) -> DataFrame:
    """The row with status (READY, or NOT_READY) and reason: of the conditions that don't hold, null ones too, the first one's."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in needs])
    return one_row.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "READY").otherwise("NOT_READY"))


def metric_rows(found: DataFrame, status_row: DataFrame) -> DataFrame:
    """The metrics where the status is READY, else no rows of the same schema."""
    return found.join(F.broadcast(status_row.where("status = 'READY'").select("status")), how="cross").drop("status")


def service_health(one: DataFrame, summary: str, priorities: str, inventory: str, passed: str, failed: str) -> DataFrame:
    """A service's row with errors and status: ok, or degraded.

    `summary` and `passed` are boolean, `priorities` and `inventory` counts, `failed` a comma-separated list; null counts as false, 0 and none.
    """
    said, gates_ok = F.coalesce(F.col(summary), F.lit(False)), F.coalesce(F.col(passed), F.lit(False))
    no_rows = lambda c: F.coalesce(F.col(c), F.lit(0)) <= 0
    some_failed = F.coalesce(F.col(failed), F.lit("")) != ""
    found = [(~said, "summary is missing"), (no_rows(priorities), "priorities have no rows"), (no_rows(inventory), "inventory has no rows"), (said & ~gates_ok, "quality gates are not passed")]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in found], F.when(some_failed, F.concat(F.lit("gates failed: "), F.col(failed)))))
    ok = said & ~no_rows(priorities) & ~no_rows(inventory) & gates_ok & ~some_failed
    return one.withColumns({"errors": F.array_join(errors, "; "), "status": F.when(ok, "ok").otherwise("degraded")})


def guards(df: DataFrame, label: str, at: str) -> DataFrame:
    """One row on whether there is enough to fit: rows, times, and both classes present."""
    y = F.col(label).cast("int")
    return df.agg(F.count(label).alias("labelled"), F.count_distinct(at).alias("times"), F.coalesce(F.min(y) < F.max(y), F.lit(False)).alias("both_classes"))


def risky_paths(df: DataFrame, path: str, suffixes: tuple[str, ...], parts: tuple[str, ...]) -> DataFrame:
    """Paths with a listed ending or part."""
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.col(path).endswith(s)
    for p in parts:
        hit = hit | F.col(path).contains(p)
    return df.where(hit)
