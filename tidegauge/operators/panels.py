"""Panels for models and services: feature frames, nested splits, policy comparison, decisions and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.clean import nullable_flag, safe_float
from .aggregate import only_keys, top_k
from .metrics import brier, classification_metrics
from .ordered import Ordered
from .temporal import chronological_cut, dense_spine, filled, lags, onto_spine, series_features, time_spine, trailing_mean


def feature_frame(df: DataFrame, ts: str, value: str, products: dict[str, tuple[str, str]], flags: dict[str, Column], steps: list[int], rows: list[int]) -> DataFrame:
    """Calendar columns, products of columns, flags as 0 and 1, lags and trailing means of one series; rows without all of them go."""
    out = df.withColumns({"hr": F.hour(ts), "weekday": cal.weekday(ts), "is_weekend": cal.is_weekend(ts).cast("int"), "is_night": cal.is_night(ts).cast("int")})
    out = out.withColumns({k: F.col(a) * F.col(b) for k, (a, b) in products.items()} | {k: c.cast("int") for k, c in flags.items()})
    return series_features(out, value, steps, dict.fromkeys(rows), [ts]).na.drop("any")


def entity_hour_frame(
    starts: DataFrame, ends: DataFrame, meta: DataFrame, weather: DataFrame, entity: str, hour: str, lat: str, lon: str, center: tuple[float, float], steps: list[int], window: int, least: int
) -> DataFrame:
    """Every entity at every hour with its starts, ends and their difference, metadata, distance to a centre, weather, calendar, lags and a trailing mean.

    starts and ends are counts (entity, hour, n) of the chosen entities; meta has a row an entity and weather a row an hour, both joined
    from the left. Rows without the longest lag go.
    """
    spine = dense_spine(starts.select(entity, hour).union(ends.select(entity, hour)), entity, hour)
    out = onto_spine(spine, starts.withColumnRenamed("n", "starts"), [entity, hour], {"starts": 0})
    out = onto_spine(out, ends.withColumnRenamed("n", "ends"), [entity, hour], {"ends": 0})
    out = out.join(meta, entity, "left").join(weather, hour, "left")
    out = out.withColumns({"net": F.col("starts") - F.col("ends"), "km": cal.haversine_km(lat, lon, *center), "hr": F.hour(hour), "weekday": cal.weekday(hour)})
    out = trailing_mean(lags(out, "starts", steps, [hour], [entity]), "starts", window, [hour], [entity], least)
    return out.dropna(subset=[f"lag_{max(steps)}"])


WEATHER = ["temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m"]


def station_hour_frame(trips: DataFrame, stations: DataFrame, weather: DataFrame, top: int, center: tuple[float, float], columns: list[str] | None = None) -> DataFrame:
    """The stations that most trips start from at every hour of their starts, with counts, metadata, weather, calendar, lags and a trailing mean.

    trips: started_at, ended_at, start_station_id, start_station_name, end_station_id, start_lat, start_lng; those without a start time,
    id or name don't count, and ends count where a counted trip ends at a chosen station. stations (a row a station_short_name at most): station_name,
    gbfs_station_id, station_lat, station_lon, capacity; where it has none, the name of the first trip (by time, then name), the median of the trips' places, and
    for capacity the chosen stations' median, or 20. weather (a row an hour at most) has `columns`; its gaps are filled over the hours, from before, else from
    after. Of stations that tie for the last place the one of smaller id is chosen; station_code numbers them by id. Rows without lag_1, lag_24 or the
    mean (of 24 hours, 12 at least) go.
    """
    columns = columns or WEATHER
    rides = trips.where("started_at is not null and start_station_id is not null and start_station_name is not null").withColumn("id", F.col("start_station_id").cast("string"))
    chosen = top_k(rides, "id", top).select("id")
    rides = only_keys(rides, chosen, "id")
    starts = rides.groupBy("id", cal.hour_floor("started_at").alias("hour")).agg(F.count("*").alias("start_count"))
    ends = rides.where("ended_at is not null").groupBy(F.col("end_station_id").cast("string").alias("id"), cal.hour_floor("ended_at").alias("hour")).agg(F.count("*").alias("end_count"))
    seen = rides.groupBy("id").agg(F.min_by("start_station_name", F.struct("started_at", "start_station_name")).alias("_name"), F.median("start_lat").alias("_lat"), F.median("start_lng").alias("_lon"))
    known = stations.select(F.col("station_short_name").cast("string").alias("id"), "station_name", "gbfs_station_id", "station_lat", "station_lon", "capacity")
    meta = seen.join(known, "id", "left")
    meta = meta.crossJoin(F.broadcast(meta.agg(F.coalesce(F.median("capacity"), F.lit(20.0)).alias("_capacity"))))
    meta = meta.select("id", F.coalesce("station_name", "_name").alias("station_name"), "gbfs_station_id", F.coalesce("station_lat", "_lat").alias("station_lat"), F.coalesce("station_lon", "_lon").alias("station_lon"), F.coalesce("capacity", "_capacity").alias("capacity"))
    meta = dense_code(meta.withColumn("distance_to_center_km", cal.haversine_km("station_lat", "station_lon", *center)), "id", "station_code")
    hours = time_spine(starts, "hour").join(weather.select(cal.hour_floor("hour").alias("hour"), *columns), "hour", "left")
    out = onto_spine(dense_spine(starts, "id", "hour"), starts, ["id", "hour"], {"start_count": 0})
    out = onto_spine(out, ends, ["id", "hour"], {"end_count": 0}).join(meta, "id").join(filled(hours, columns, ["hour"]), "hour")
    hr = F.hour("hour")
    flags = {"weekday": cal.weekday("hour"), "hr": hr, "is_weekend": cal.is_weekend("hour").cast("int"), "is_commute_peak": cal.is_commute("hour", ((7, 9), (16, 19)), workdays_only=False).cast("int"), "is_night": hr.between(0, 5).cast("int")}
    if "precipitation" in columns:
        flags["precipitation_flag"] = F.coalesce((F.col("precipitation") > 0).cast("int"), F.lit(0))
    out = series_features(out.withColumns(flags), "start_count", [1, 24], {24: 12}, ["hour"], ["id"])
    return out.withColumnRenamed("trailing_24", "rolling_24_mean").dropna(subset=["lag_1", "lag_24", "rolling_24_mean"]).withColumnRenamed("id", "station_short_name")


def model_frame(panel: DataFrame, at: str, y: str, flags: list[str], numbers: list[str]) -> DataFrame:
    """Labelled rows with flags as 0 and 1 (unknown is 0), calendar columns, and numbers whose gaps take the median (0 if there is none)."""
    out = panel.dropna(subset=[at, y]).withColumns({y: nullable_flag(y).cast("int")} | {c: F.coalesce(nullable_flag(c).cast("int"), F.lit(0)) for c in flags})
    out = out.withColumns({"hour": F.hour(at), "dayofweek": cal.weekday(at), "is_weekend": cal.is_weekend(at).cast("int")} | {c: safe_float(c) for c in numbers})
    medians = out.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"_m_{c}") for c in numbers])
    out = out.crossJoin(F.broadcast(medians))
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in numbers}).drop(*[f"_m_{c}" for c in numbers])


def calibration_splits(df: DataFrame, at: str, test: float = 0.25, calibration: float = 0.20) -> DataFrame:
    """part: fit, calibration or test, by distinct times: the last `test` of all, then the last `calibration` of the rest. None with fewer than four times."""
    outer = chronological_cut(df, at, test)
    rest = df.crossJoin(F.broadcast(outer.withColumnRenamed("cut", "_outer")))
    inner = chronological_cut(rest.where(F.col(at) <= F.col("_outer")), at, calibration)
    named = rest.crossJoin(F.broadcast(inner.withColumnRenamed("cut", "_inner")))
    part = F.when(F.col(at) > F.col("_outer"), "test").when(F.col(at) > F.col("_inner"), "calibration").otherwise("fit")
    return named.withColumn("part", part).drop("_outer", "_inner")


def split_guards(parts: DataFrame, y: str, hour: str) -> DataFrame:
    """A row a part: rows, whether both classes are there, and rows of the night hours 0 to 5."""
    label = F.col(y).cast("int")
    return parts.groupBy("part").agg(F.count("*").alias("rows"), F.coalesce(F.min(label) < F.max(label), F.lit(False)).alias("both_classes"), F.count_if(F.col(hour).between(0, 5)).alias("night_rows"))


def policy_comparison(df: DataFrame, split: str, y: str, hour: str, policies: dict[str, tuple[str, str]]) -> DataFrame:
    """(split, policy, segment, metrics and brier) for all rows, those of the night hours 0 to 5 and the others; a policy is (predicted, score) columns. One pass."""
    night = F.col(hour).between(0, 5)
    segments = F.array_compact(F.array(F.lit("all"), F.when(night, "night").otherwise("day")))
    each = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(p).cast("boolean").alias("p"), F.col(s).cast("double").alias("s")) for n, (p, s) in policies.items()])
    rows = df.select(split, F.col(y).cast("boolean").alias("y"), F.explode(each).alias("e"), segments.alias("segments"))
    rows = rows.select(split, "y", "e.*", F.explode("segments").alias("segment"))
    return rows.groupBy(split, "policy", "segment").agg(*classification_metrics("y", "p"), brier("y", "s"))


def deployment_decision(comparison: DataFrame, split: str, base: str, candidate: str, most_drop: float = 0.01, least_gain: float = 0.02) -> DataFrame:
    """One row: decision and the failed gates. In each split the candidate's f1 may fall short of the base's by `most_drop` over all rows and must exceed it by `least_gain` at night."""
    value = lambda policy, segment: F.max(F.when((F.col("policy") == policy) & (F.col("segment") == segment), F.col("f1")))
    gains = comparison.groupBy(split).agg((value(candidate, "all") - value(base, "all")).alias("overall"), (value(candidate, "night") - value(base, "night")).alias("night"))
    failed = F.array(F.when(~F.coalesce(F.col("overall") >= -most_drop, F.lit(False)), F.concat(F.col(split), F.lit("_overall"))), F.when(~F.coalesce(F.col("night") >= least_gain, F.lit(False)), F.concat(F.col(split), F.lit("_night"))))
    out = gains.select(F.explode_outer(F.array_compact(failed)).alias("gate")).agg(F.array_join(F.sort_array(F.collect_list("gate")), ", ").alias("failed"))
    return out.select(F.when(F.col("failed") == "", candidate).otherwise(base).alias("decision"), "failed")


def fold_best(metrics: DataFrame, fold: str = "fold", metric: str = "f1") -> DataFrame:
    """One row: the number of folds, and mean and least of each fold's best value."""
    best = metrics.groupBy(fold).agg(F.max(metric).alias("best"))
    return best.agg(F.count("*").alias("folds"), F.avg("best").alias("best_mean"), F.min("best").alias("best_worst"))


def monitoring_payload(df: DataFrame, at: str, cutoff: Column, state: str, checks: DataFrame) -> DataFrame:
    """One row on the rows up to the cutoff, included, and those after it: snapshots, rows and state rates of both, and checks passed. Rows after the cutoff never enter the first."""
    old = F.col(at) <= cutoff
    flag = F.col(state).cast("int")
    one = df.agg(
        F.count_distinct(F.when(old, F.col(at))).alias("reference_snapshots"), F.count_distinct(F.when(~old, F.col(at))).alias("monitoring_snapshots"),
        F.count_if(old).alias("reference_rows"), F.count_if(~old).alias("monitoring_rows"), F.avg(F.when(old, flag)).alias("reference_rate"), F.avg(F.when(~old, flag)).alias("monitoring_rate"),
    )
    passed = checks.agg(F.count_if(F.col("status") == "PASS").alias("checks_passed"), F.count("*").alias("check_count"))
    good = F.col("checks_passed") == F.col("check_count")
    reason = F.when(good, "within drift limits").otherwise("one or more drift checks need review")
    return one.crossJoin(F.broadcast(passed)).withColumns({"status": F.when(good, "PASS").otherwise("REVIEW_REQUIRED"), "decision": F.lit("NO_AUTOMATIC_MODEL_CHANGE"), "reason": reason})


def service_payload(points: DataFrame, priority: DataFrame, metrics: DataFrame, needed: list[str]) -> DataFrame:
    """One row for a service: counts of places and priorities, the metrics, and the needed fields that are null as `missing`, with ok."""
    one = points.agg(F.count("*").alias("stations")).crossJoin(F.broadcast(priority.agg(F.count("*").alias("priorities")))).crossJoin(F.broadcast(metrics))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in needed])), ",")
    return one.withColumn("missing", missing).withColumn("ok", (F.col("missing") == "") & (F.col("stations") > 0))


def rule_input(df: DataFrame, columns: dict[str, str], source: str) -> DataFrame:
    """The columns that a rule takes, by its names; a missing or null source becomes `source`."""
    own = F.coalesce(F.col("source"), F.lit(source)) if "source" in df.columns else F.lit(source)
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()], own.alias("source"))


def dense_code(df: DataFrame, key: str, name: str = "code") -> DataFrame:
    """A code from 0 for each key in order; keys are numbered once each, and joined back."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    codes = Ordered(keys, [key]).numbered("_row").select(key, (F.col("_row") - 1).alias(name))
    return df.join(codes, key, "left")


def sampled(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """At most `rows` rows without replacement: those of least digest of seed and key, the same on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(rows)


def join_rate(df: DataFrame, other: DataFrame, keys: list[str], name: str = "join_rate") -> DataFrame:
    """One row: the share of rows that have a partner in other."""
    return df.join(other.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left").agg(F.avg(F.col("_hit").isNotNull().cast("int")).alias(name))
