"""Catalogue queries on panels, models' frames, decisions and payloads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import clean
from ..operators import aggregate as agg
from ..operators import drift, gates, metrics, models, panels
from ..operators import inventory as inv
from ..operators import temporal as tm
from ..sources import readers, sinks
from .demand_queries import DAILY, HOURLY, PANEL, TOP, WEATHER, daily, hourly, labelled, t, weather
from .stock_queries import PSI, READY, gate_rows

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


NAN = "CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


@query(f"""SELECT event_id, (floor((month(ts) % 12) / 3) + 1)::INTEGER AS season, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS local_iso,
  CASE WHEN event_id % 3 = 0 THEN trunc(value)::BIGINT END AS whole, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE event_type END AS kind,
  CASE WHEN event_id % 5 <> 0 THEN value END AS cleaned FROM events""")
def q55_calendar_and_defaults(spark, d):
    e = t(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise("x")
    kind = F.when(F.col("event_id") % 8 == 0, F.lit("")).when(F.col("event_id") % 4 != 0, F.col("event_type"))
    out = e.select("event_id", cal.season("ts").alias("season"), cal.iso_in_zone("ts", "Asia/Seoul").alias("local_iso"), clean.truncated_int(raw).alias("whole"), clean.or_default(kind, "none").alias("kind"), F.expr(NAN).alias("cleaned"))
    return clean.clean_doubles(out)


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 23 HOUR FROM events)")
def q56_last_hours(spark, d):
    return tm.last_hours(t(spark, d, "events").select("event_id", "ts"), "ts", 24)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 0 WHEN l_partkey % 11 = 0 THEN NULL ELSE 50 END::DOUBLE cap, l_quantity units, 50 - l_quantity room FROM lineitem)
SELECT l_orderkey, l_linenumber, units / nullif(cap, 0) AS stock_rate, room / nullif(cap, 0) AS space_rate, CASE WHEN cap > 0 THEN units <= ceil(greatest(cap * 0.1::DOUBLE, 1)) END AS stock_short,
  CASE WHEN cap > 0 THEN room <= ceil(greatest(cap * 0.1::DOUBLE, 1)) END AS space_short FROM s""")
def q57_shortage_flags(spark, d):
    cap = F.when(F.col("l_partkey") % 9 == 0, 0.0).when(F.col("l_partkey") % 11 == 0, F.lit(None)).otherwise(50.0)
    s = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cap.cast("double").alias("cap"), F.col("l_quantity").alias("units"), (50 - F.col("l_quantity")).alias("room"))
    return inv.with_shortage_flags(s, "cap", "units", "room").select("l_orderkey", "l_linenumber", "stock_rate", "space_rate", "stock_short", "space_short")


@query(f"""WITH {HOURLY}, f AS (SELECT user_id, sum(n) s, max(n) AS peak, count(*) AS hours FROM hourly WHERE hour >= TIMESTAMP '2024-01-21' GROUP BY 1),
live AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 9 > 0 THEN c_nationkey END::DOUBLE AS capacity, c_acctbal < 0 AS low FROM customer),
r AS (SELECT user_id, s AS forecast_sum, peak, hours, (s + 1.5::DOUBLE * sqrt(24)) / CASE WHEN capacity IS NOT NULL THEN greatest(capacity, 1) END AS risk, capacity, CASE WHEN low THEN 0.75 ELSE 0 END AS boost FROM f LEFT JOIN live USING (user_id))
SELECT user_id, forecast_sum, peak, hours, round(risk + boost, 6) AS risk, ceil(CASE WHEN risk > 1 THEN risk - 1 WHEN risk <= 1 THEN 0 END * capacity * 0.25) AS buffer FROM r ORDER BY risk + boost DESC NULLS LAST, user_id LIMIT 400""")
def q58_forecast_priority(spark, d):
    day = hourly(spark, d).where("hour >= TIMESTAMP_NTZ '2024-01-21 00:00:00'")
    live = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 9 > 0, F.col("c_nationkey")).cast("double").alias("capacity"), (F.col("c_acctbal") < 0).alias("low"))
    out = inv.forecast_priority(day, "user_id", "n", 1.5, live, "capacity", "low", 400)
    return out.select("user_id", "forecast_sum", "peak", "hours", F.round("risk", 6).alias("risk"), "buffer")


@query("""SELECT 'user_id' AS "column", count(*) - count(user_id) AS missing, min(user_id::VARCHAR) AS example FROM events UNION ALL SELECT 'event_type', count(*) - count(event_type), min(event_type) FROM events""")
def q59_column_profile(spark, d):
    return agg.column_profile(t(spark, d, "events").select("user_id", "event_type")).drop("type")


@query("WITH c AS (SELECT event_type k, count(*) n FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM c")
def q59_counts_map(spark, d):
    one = agg.counts_map(t(spark, d, "events"), "event_type")
    return one.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""WITH p AS (SELECT o_custkey AS page, count(*) AS rows, min(o_totalprice) > 0 AS ok FROM orders WHERE o_custkey < 40 GROUP BY 1)
SELECT count(*) AS pages, sum(rows)::BIGINT AS rows, bool_and(ok) AS all_ok, CASE WHEN NOT bool_and(ok) THEN 'error' WHEN arg_max(rows < 12, page) THEN 'last_page' ELSE 'page_limit' END AS stopped_by FROM p""")
def q60_page_summary(spark, d):
    o = t(spark, d, "orders").where("o_custkey < 40")
    pages = o.groupBy(F.col("o_custkey").alias("page")).agg(F.count("*").alias("rows"), (F.min("o_totalprice") > 0).alias("ok")).withColumn("page_size", F.lit(12))
    return gates.page_summary(pages)


@query("""WITH i AS (SELECT event_id AS row_key, 'k' AS field, CASE WHEN k IS NULL THEN 'missing' WHEN NOT regexp_full_match(k, '-?[0-9]+') THEN 'wrong_type' ELSE 'out_of_range' END AS issue FROM (SELECT event_id, nullif(trim(props ->> '$.k'), '') AS k FROM events)
WHERE k IS NULL OR NOT regexp_full_match(k, '-?[0-9]+') OR NOT try_cast(k AS DOUBLE) BETWEEN 0 AND 50) SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY issue ORDER BY field, row_key) <= 20""")
def q61_capped_report(spark, d):
    e = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return gates.reported(gates.contract_issues(e, "event_id", [gates.FieldRule("k", "int", 0, 50)]), 20)


@query(f"WITH {PANEL} SELECT count(next_high) AS labelled, count(DISTINCT ts) AS times, coalesce(min(next_high::INTEGER) < max(next_high::INTEGER), false) AS both_classes FROM labelled")
def q61_guards(spark, d):
    return gates.guards(labelled(spark, d), "next_high", "ts")


NEEDS = """g AS (SELECT count(next_high) AS labelled, count(DISTINCT ts) AS times, coalesce(min(next_high::INTEGER) < max(next_high::INTEGER), false) AS both_classes FROM labelled WHERE ts < TIMESTAMP '{until}'),
st AS (SELECT *, CASE WHEN NOT labelled > 0 THEN 'no labels' WHEN NOT times >= 40 THEN 'too few snapshots' WHEN NOT both_classes THEN 'one class' END AS reason FROM g), got AS (SELECT *, CASE WHEN reason IS NULL THEN 'READY' ELSE 'NOT_READY' END AS status FROM st)"""


def status_until(spark, d, until: str):
    return gates.status(gates.guards(labelled(spark, d).where(f"ts < TIMESTAMP_NTZ '{until}'"), "next_high", "ts"), [(F.col("labelled") > 0, "no labels"), (F.col("times") >= 40, "too few snapshots"), (F.col("both_classes"), "one class")])


@query(f"WITH {PANEL}, {NEEDS.format(until='2024-01-01 00:30:00')} SELECT * FROM got")
def q61_not_ready(spark, d):
    return status_until(spark, d, "2024-01-01 00:30:00")


METRIC = "met AS (SELECT 'persistence' AS model, count(*) AS rows, avg((next_high = high)::INTEGER) AS accuracy FROM labelled WHERE next_high IS NOT NULL GROUP BY 1)"


@query(f"WITH {PANEL}, {NEEDS.format(until='2024-01-09 00:00:00')}, {METRIC} SELECT met.* FROM met, got WHERE status = 'READY'")
def q61_ready_metrics(spark, d):
    rows = labelled(spark, d).where("next_high is not null")
    found = rows.agg(F.lit("persistence").alias("model"), F.count("*").alias("rows"), F.avg((F.col("next_high") == F.col("high")).cast("int")).alias("accuracy"))
    return gates.metric_rows(found, status_until(spark, d, "2024-01-09 00:00:00"))


@query(f"WITH {PANEL}, {NEEDS.format(until='2023-01-01 00:00:00')}, {METRIC} SELECT met.* FROM met, got WHERE status = 'READY'")
def q61_no_metrics(spark, d):
    """No rows, of the metrics' schema, where there is nothing to evaluate."""
    rows = labelled(spark, d).where("next_high is not null")
    found = rows.agg(F.lit("persistence").alias("model"), F.count("*").alias("rows"), F.avg((F.col("next_high") == F.col("high")).cast("int")).alias("accuracy"))
    return gates.metric_rows(found, status_until(spark, d, "2023-01-01 00:00:00"))


@query("SELECT page_id, url FROM pages WHERE ends_with(url, '.html') OR ends_with(url, '.env') OR contains(url, '/fr/')")
def q61_risky_paths(spark, d):
    return gates.risky_paths(t(spark, d, "pages").select("page_id", "url"), "url", (".html", ".env"), ("/fr/",))


@query("""SELECT o_orderkey, substr(sha256('["' || coalesce(o_orderkey::VARCHAR, '') || '","' || coalesce(o_orderstatus, '') || '"]'), 1, 16) AS event_key FROM orders""")
def q61_event_key(spark, d):
    return t(spark, d, "orders").select("o_orderkey", clean.event_key("o_orderkey", "o_orderstatus").alias("event_key"))


@query("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS code FROM customer")
def q62_dense_code(spark, d):
    return panels.dense_code(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def q62_latest(spark, d):
    return tm.latest(t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")


@query(f"WITH {DAILY} SELECT day, n FROM daily ORDER BY day LIMIT 336")
def q62_head_of_series(spark, d):
    return daily(spark, d).orderBy("day").limit(336)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 400")
def q62_sample(spark, d):
    return panels.sampled(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 400)


@query(f"""WITH {WEATHER}, c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), j AS (SELECT hour, coalesce(n, 0) AS n, level FROM weather LEFT JOIN c USING (hour)),
f AS (SELECT *, hour(hour)::INTEGER AS hr, (isodow(hour) - 1)::INTEGER AS weekday, (isodow(hour) >= 6)::INTEGER AS is_weekend, (hour(hour) >= 22 OR hour(hour) <= 5)::INTEGER AS is_night, level * n AS product, (level > 50)::INTEGER AS high,
  lag(n, 1) OVER v AS lag_1, lag(n, 24) OVER v AS lag_24, avg(n) OVER (v ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS trailing_24 FROM j WINDOW v AS (ORDER BY hour))
SELECT hour, n, round(level, 6) AS level, hr, weekday, is_weekend, is_night, round(product, 4) AS product, high, lag_1, lag_24, round(trailing_24, 6) AS trailing_24 FROM f WHERE lag_24 IS NOT NULL""")
def q63_feature_frame(spark, d):
    counts = t(spark, d, "events").groupBy(cal.hour_floor("ts").alias("hour")).agg(F.count("*").alias("n"))
    series = weather(spark, d).join(counts, "hour", "left").fillna({"n": 0}).select("hour", "n", "level")
    out = panels.feature_frame(series, "hour", "n", {"product": ("level", "n")}, {"high": F.col("level") > 50}, [1, 24], [24])
    return out.withColumns({"level": F.round("level", 6), "product": F.round("product", 4), "trailing_24": F.round("trailing_24", 6)})


@query(f"""WITH {TOP.format(k=20)}, {WEATHER}, e AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_type FROM events WHERE user_id IN (SELECT user_id FROM top)),
a AS (SELECT user_id, hour, count(*) n FROM e WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, hour, count(*) n FROM e WHERE event_type <> 'click' GROUP BY ALL), u AS (SELECT user_id, hour FROM a UNION ALL SELECT user_id, hour FROM b),
s AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT user_id FROM u), (SELECT min(hour) lo, max(hour) hi FROM u)),
m AS (SELECT c_custkey AS user_id, 37.4 + (c_custkey % 100) / 500.0::DOUBLE AS lat, 126.8 + (c_custkey % 77) / 300.0::DOUBLE AS lon FROM customer),
f AS (SELECT s.user_id, s.hour, coalesce(a.n, 0) starts, coalesce(b.n, 0) ends, lat, lon, level FROM s LEFT JOIN a USING (user_id, hour) LEFT JOIN b USING (user_id, hour) LEFT JOIN m USING (user_id) LEFT JOIN weather USING (hour)),
w AS (SELECT *, lag(starts, 1) OVER v lag_1, lag(starts, 24) OVER v lag_24, avg(starts) OVER (v ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS tr FROM f WINDOW v AS (PARTITION BY user_id ORDER BY hour))
SELECT user_id, hour, starts, ends, starts - ends AS net, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 37.5665) / 2), 2) + cos(radians(37.5665)) * cos(radians(lat)) * pow(sin(radians(lon - 126.978) / 2), 2))), 6) AS km,
  round(level, 6) AS level, hour(hour)::INTEGER AS hr, lag_1, lag_24, round(tr, 6) AS trailing_24 FROM w WHERE lag_24 IS NOT NULL""")
def q64_entity_hour_frame(spark, d):
    e = t(spark, d, "events")
    e = agg.only_keys(e, agg.top_k(e, "user_id", 20), "user_id").select("user_id", cal.hour_floor("ts").alias("hour"), "event_type")
    counts = lambda cond: e.where(cond).groupBy("user_id", "hour").agg(F.count("*").alias("n"))
    key = F.col("c_custkey")
    meta = t(spark, d, "customer").select(key.alias("user_id"), (37.4 + (key % 100) / 500.0).alias("lat"), (126.8 + (key % 77) / 300.0).alias("lon"))
    out = panels.entity_hour_frame(counts("event_type = 'click'"), counts("event_type <> 'click'"), meta, weather(spark, d), "user_id", "hour", "lat", "lon", (37.5665, 126.978), [1, 24], 24, 12)
    return out.select("user_id", "hour", "starts", "ends", "net", F.round("km", 6).alias("km"), F.round("level", 6).alias("level"), "hr", "lag_1", "lag_24", F.round("trailing_24", 6).alias("trailing_24"))


TIMES = "x AS (SELECT *, date_trunc('hour', ts) AS cap FROM labelled WHERE next_high IS NOT NULL)"
CUTS = f"""{PANEL}, {TIMES}, r1 AS (SELECT cap, row_number() OVER (ORDER BY cap) r, count(*) OVER () n FROM (SELECT DISTINCT cap FROM x)), c1 AS (SELECT cap AS a FROM r1 WHERE r = least(greatest(floor(n * 0.75::DOUBLE), 1), n - 1)),
r2 AS (SELECT cap, row_number() OVER (ORDER BY cap) r, count(*) OVER () n FROM (SELECT DISTINCT cap FROM x, c1 WHERE cap <= a)), c2 AS (SELECT cap AS b FROM r2 WHERE r = least(greatest(floor(n * 0.8::DOUBLE), 1), n - 1)),
parts AS (SELECT x.*, CASE WHEN cap > a THEN 'test' WHEN cap > b THEN 'calibration' ELSE 'fit' END AS part, hour(ts)::INTEGER AS hr FROM x, c1, c2)"""


def parts(spark, d):
    x = labelled(spark, d).where("next_high is not null").withColumns({"at": cal.hour_floor("ts"), "hr": F.hour("ts")})
    return panels.calibration_splits(x, "at", 0.25, 0.20)


@query(f"WITH {CUTS} SELECT part, count(*) AS rows, min(next_high::INTEGER) < max(next_high::INTEGER) AS both_classes, count(*) FILTER (hr BETWEEN 0 AND 5) AS night_rows FROM parts GROUP BY 1")
def q65_calibration_splits(spark, d):
    return panels.split_guards(parts(spark, d), "next_high", "hr")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) r, count(*) OVER () n FROM orders) SELECT o_orderkey, CASE WHEN r > n - 5 * (n // 6) THEN ((r - (n - 5 * (n // 6)) - 1) // (n // 6) + 1) ELSE 0 END::INTEGER AS test_fold FROM r")
def q65_row_fold_of(spark, d):
    return tm.row_fold_of(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@query(f"""WITH {PANEL}, m AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS v FROM labelled WHERE next_high IS NOT NULL), k AS (SELECT median(try_cast(v AS DOUBLE)) AS mid FROM m)
SELECT event_id, next_high::INTEGER AS next_high, coalesce(high::INTEGER, 0) AS high, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dayofweek, (isodow(ts) >= 6)::INTEGER AS is_weekend, coalesce(try_cast(v AS DOUBLE), mid) AS v FROM m, k""")
def q66_model_frame(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    out = panels.model_frame(labelled(spark, d).withColumn("v", v), "ts", "next_high", ["high"], ["v"])
    return out.select("event_id", "next_high", "high", "hour", "dayofweek", "is_weekend", "v")


@query("""WITH f AS (SELECT l_returnflag AS fold, l_linestatus, avg(l_discount) f1 FROM lineitem GROUP BY ALL), b AS (SELECT fold, max(f1) best FROM f GROUP BY 1) SELECT count(*) AS folds, round(avg(best), 6) AS best_mean, round(min(best), 6) AS best_worst FROM b""")
def q67_fold_best(spark, d):
    f = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("fold"), "l_linestatus").agg(F.avg("l_discount").alias("f1"))
    one = panels.fold_best(f)
    return one.select("folds", F.round("best_mean", 6).alias("best_mean"), F.round("best_worst", 6).alias("best_worst"))


AUDIT = f"""{PANEL}, {TIMES}, rt AS (SELECT cap, row_number() OVER (ORDER BY cap) r, count(*) OVER () n FROM (SELECT DISTINCT cap FROM x)), sz AS (SELECT DISTINCT n, floor(n * 0.5)::BIGINT f, (n - floor(n * 0.5)::BIGINT) // 3 AS s FROM rt WHERE n >= 7),
fd AS (SELECT k::INTEGER AS fold, f + (k - 1) * s AS a, CASE WHEN k = 3 THEN n ELSE f + k * s END AS b FROM sz, generate_series(1, 3) g(k)), te AS (SELECT fold, x.* FROM x JOIN rt USING (cap) JOIN fd ON r > a AND r <= b),
pm AS (SELECT fold, 'persistence' AS policy, next_high AS y, high AS p FROM te UNION ALL SELECT fold, 'threshold', next_high, value >= 45 FROM te),
am AS (SELECT fold, policy, count(*) AS rows, coalesce(2 * count(*) FILTER (y AND p) / nullif(count(*) FILTER (y) + count(*) FILTER (p), 0), 0) AS f1 FROM pm GROUP BY ALL)"""


def audit(spark, d):
    """(fold, policy, metrics) of two policies on the test window of each rolling-origin fold, which a row falls into by its hour."""
    rows = labelled(spark, d).where("next_high is not null").withColumns({"at": cal.hour_floor("ts"), "over": F.col("value") >= 45})
    folds = F.broadcast(tm.fold_bounds(rows, "at", 3))
    tested = rows.join(folds, (F.col("at") > F.col("train_end")) & (F.col("at") <= F.col("test_end")))
    each = F.explode(F.array(F.struct(F.lit("persistence").alias("policy"), F.col("high").alias("p")), F.struct(F.lit("threshold").alias("policy"), F.col("over").alias("p"))))
    said = tested.select("fold", F.col("next_high").alias("y"), each.alias("e")).select("fold", "y", "e.*")
    return said.groupBy("fold", "policy").agg(*metrics.classification_metrics("y", "p"))


@query(f"WITH {AUDIT} SELECT fold, policy, rows, round(f1, 6) AS f1 FROM am")
def q67_rolling_audit(spark, d):
    return audit(spark, d).select("fold", "policy", "rows", F.round("f1", 6).alias("f1"))


@query(f"WITH {AUDIT}, bs AS (SELECT fold, max(f1) AS best FROM am GROUP BY 1) SELECT count(*) AS folds, round(avg(best), 6) AS best_mean, round(min(best), 6) AS best_worst FROM bs")
def q67_rolling_best(spark, d):
    one = panels.fold_best(audit(spark, d))
    return one.select("folds", F.round("best_mean", 6).alias("best_mean"), F.round("best_worst", 6).alias("best_worst"))


POLICY = f"""{CUTS}, pol AS (SELECT part, hr, next_high AS y, high AS p, high::INTEGER::DOUBLE AS s, 'persistence' AS policy FROM parts WHERE part <> 'fit' UNION ALL
SELECT part, hr, next_high, value / 100 >= CASE WHEN hr BETWEEN 0 AND 5 THEN 0.6 ELSE 0.45 END, value / 100, 'candidate' FROM parts WHERE part <> 'fit'),
seg AS (SELECT *, 'all' AS segment FROM pol UNION ALL SELECT *, CASE WHEN hr BETWEEN 0 AND 5 THEN 'night' ELSE 'day' END FROM pol),
met AS (SELECT part, policy, segment, count(*) AS rows, avg((y = p)::INTEGER) AS accuracy, coalesce(count(*) FILTER (y AND p) / nullif(count(*) FILTER (p), 0), 0) AS precision, coalesce(count(*) FILTER (y AND p) / nullif(count(*) FILTER (y), 0), 0) AS recall,
coalesce(2 * count(*) FILTER (y AND p) / nullif(count(*) FILTER (y) + count(*) FILTER (p), 0), 0) AS f1, CASE WHEN min(y::INTEGER) < max(y::INTEGER) THEN avg(pow(s - y::INTEGER, 2)) ELSE 1 END AS brier FROM seg GROUP BY ALL)"""


def comparison(spark, d):
    rows = parts(spark, d).where("part <> 'fit'").withColumn("score", F.col("value") / 100)
    limit = F.when(F.col("hr").between(0, 5), 0.6).otherwise(0.45)
    rows = rows.withColumns({"said": F.col("score") >= limit, "now": F.col("high").cast("double")})
    return panels.policy_comparison(rows, "part", "next_high", "hr", {"persistence": ("high", "now"), "candidate": ("said", "score")})


@query(f"WITH {POLICY} SELECT part, policy, segment, rows, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(brier, 6) AS brier FROM met")
def q68_policy_comparison(spark, d):
    c = comparison(spark, d)
    return c.select("part", "policy", "segment", "rows", *[F.round(k, 6).alias(k) for k in ("accuracy", "precision", "recall", "f1", "brier")])


@query(f"""WITH {POLICY}, w AS (SELECT part, max(f1) FILTER (policy = 'candidate' AND segment = 'all') - max(f1) FILTER (policy = 'persistence' AND segment = 'all') AS o, max(f1) FILTER (policy = 'candidate' AND segment = 'night') - max(f1) FILTER (policy = 'persistence' AND segment = 'night') AS n FROM met GROUP BY 1),
g AS (SELECT part || '_overall' AS gate FROM w WHERE NOT coalesce(o >= -0.01, false) UNION ALL SELECT part || '_night' FROM w WHERE NOT coalesce(n >= 0.02, false)), one AS (SELECT coalesce(string_agg(gate, ', ' ORDER BY gate), '') AS failed FROM g)
SELECT CASE WHEN failed = '' THEN 'candidate' ELSE 'persistence' END AS decision, failed FROM one""")
def q68_deployment_decision(spark, d):
    return panels.deployment_decision(comparison(spark, d), "part", "persistence", "candidate")


CUT = "TIMESTAMP '2024-01-16 12:00:00'"
TIMES_TV = f"""hh AS (SELECT hour(ts) hr, count(*) FILTER (ts <= {CUT}) a, count(*) FILTER (ts > {CUT}) b FROM (SELECT DISTINCT ts FROM events) GROUP BY 1),
tv AS (SELECT 0.5 * sum(abs(coalesce(a, 0) / (SELECT sum(a) FROM hh) - coalesce(b, 0) / (SELECT sum(b) FROM hh))) AS v FROM generate_series(0, 23) g(h) LEFT JOIN hh ON hr = h)"""
CHECKS = f"""y AS (SELECT abs(avg((value > 50)::INTEGER) FILTER (ts <= {CUT}) - avg((value > 50)::INTEGER) FILTER (ts > {CUT})) AS v FROM events), {PSI.replace("< TIMESTAMP '2024-01-16'", f"<= {CUT}")}, {TIMES_TV},
mb AS (SELECT avg((user_id IN (SELECT user_id FROM events WHERE ts <= {CUT}))::INTEGER) v FROM events WHERE ts > {CUT}),
ck AS (SELECT (SELECT v FROM y) <= 0.05 AS a, (SELECT psi FROM psi) <= 0.25 AS b, (SELECT v FROM tv) <= 0.2 AS c, (SELECT v FROM mb) >= 0.95 AS d),
k AS (SELECT a::INTEGER + b::INTEGER + c::INTEGER + d::INTEGER AS checks_passed, 4 AS check_count FROM ck)"""
#: Of the post-cutoff check.
MONITORING = {"rate_difference": (0.05, "max"), "psi": (0.25, "max"), "hour_distance": (0.20, "max"), "membership_rate": (0.95, "min")}


@query(f"""WITH {CHECKS}
SELECT count(DISTINCT CASE WHEN ts <= {CUT} THEN ts END) AS reference_snapshots, count(DISTINCT CASE WHEN ts > {CUT} THEN ts END) AS monitoring_snapshots, count(*) FILTER (ts <= {CUT}) AS reference_rows, count(*) FILTER (NOT ts <= {CUT}) AS monitoring_rows,
avg((value > 50)::INTEGER) FILTER (ts <= {CUT}) AS reference_rate, avg((value > 50)::INTEGER) FILTER (NOT ts <= {CUT}) AS monitoring_rate, any_value(checks_passed)::BIGINT AS checks_passed, any_value(check_count)::BIGINT AS check_count,
CASE WHEN any_value(checks_passed) = any_value(check_count) THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS status, 'NO_AUTOMATIC_MODEL_CHANGE' AS decision,
CASE WHEN any_value(checks_passed) = any_value(check_count) THEN 'within drift limits' ELSE 'one or more drift checks need review' END AS reason FROM events, k""")
def q69_monitoring_payload(spark, d):
    e = t(spark, d, "events").withColumn("high", F.col("value") > 50)
    cut = F.expr("TIMESTAMP_NTZ '2024-01-16 12:00:00'")
    checks = drift.drift_table(e, F.col("ts") <= cut, "ts", "user_id", "value", "high", distinct_times=True, limits=MONITORING, bad="REVIEW_REQUIRED")
    return panels.monitoring_payload(e, "ts", cut, "high", checks)


@query(f"WITH f AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events) SELECT (SELECT count(*) FROM f) - (SELECT count(*) FROM f WHERE day <= {CUT}) AS after_cutoff")
def q69_after_cutoff(spark, d):
    days = t(spark, d, "events").select(cal.day_floor("ts").alias("day")).distinct()
    return days.agg((F.count("*") - F.count_if(F.expr("day <= TIMESTAMP_NTZ '2024-01-16 12:00:00'"))).alias("after_cutoff"))


@query("""WITH p AS (SELECT count(*) AS stations FROM supplier), r AS (SELECT count(*) AS priorities FROM supplier WHERE s_acctbal < 0), m AS (SELECT round(avg(s_acctbal), 4) AS mean_balance, NULL::DOUBLE AS best_f1 FROM supplier)
SELECT stations, priorities, mean_balance, best_f1, 'best_f1' AS missing, false AS ok FROM p, r, m""")
def q70_service_payload(spark, d):
    s = t(spark, d, "supplier")
    one = s.agg(F.round(F.avg("s_acctbal"), 4).alias("mean_balance"), F.lit(None).cast("double").alias("best_f1"))
    return panels.service_payload(s, s.where("s_acctbal < 0"), one, ["mean_balance", "best_f1"])


@query(f"""WITH {READY}, g AS (SELECT snapshots >= 268 a, labels >= 1000000 b, entities >= 10 c FROM ready), one AS (SELECT a AND b AND c AS passed, concat_ws(',', CASE WHEN NOT b THEN 'enough_labels' END, CASE WHEN NOT a THEN 'enough_snapshots' END, CASE WHEN NOT c THEN 'many_entities' END) AS failed FROM g),
p AS (SELECT count(*) FILTER (s_acctbal < 0) AS low, count(*) AS every, count(*) FILTER (s_acctbal < -1e9) AS none FROM supplier)
SELECT 'gates' AS service, true AS summary, low AS priorities, every AS inventory, passed, failed, concat_ws('; ', CASE WHEN low <= 0 THEN 'priorities have no rows' END, CASE WHEN every <= 0 THEN 'inventory has no rows' END, CASE WHEN NOT passed THEN 'quality gates are not passed' END, CASE WHEN failed <> '' THEN 'gates failed: ' || failed END) AS errors,
  CASE WHEN low > 0 AND every > 0 AND passed AND failed = '' THEN 'ok' ELSE 'degraded' END AS status FROM one, p
UNION ALL SELECT 'whole', true, every, every, true, '', CASE WHEN every <= 0 THEN 'priorities have no rows; inventory has no rows' ELSE '' END, CASE WHEN every > 0 THEN 'ok' ELSE 'degraded' END FROM p
UNION ALL SELECT 'missing', false, none, every, NULL, NULL, 'summary is missing; priorities have no rows' || CASE WHEN every <= 0 THEN '; inventory has no rows' ELSE '' END, 'degraded' FROM p""")
def q70_service_health(spark, d):
    """Three services: one whose gates decide, one that is whole, and one without a summary, priorities or gates."""
    s = t(spark, d, "supplier").agg(F.count_if(F.col("s_acctbal") < 0).alias("low"), F.count("*").alias("every"), F.count_if(F.col("s_acctbal") < -1e9).alias("none"))
    decided = gates.gate_decision(gate_rows(spark, d)).select(F.col("all_passed").alias("passed"), "failed")
    names = ("service", "summary", "priorities", "inventory", "passed", "failed")
    row = lambda *v: F.struct(*[(F.col(x[1:]) if isinstance(x, str) and x.startswith("@") else F.lit(x)).cast(k).alias(n) for n, k, x in zip(names, ("string", "boolean", "long", "long", "boolean", "string"), v)])
    each = F.array(row("gates", True, "@low", "@every", "@passed", "@failed"), row("whole", True, "@every", "@every", True, ""), row("missing", False, "@none", "@every", None, None))
    rows = s.crossJoin(F.broadcast(decided)).select(F.inline(each))
    return gates.service_health(rows, "summary", "priorities", "inventory", "passed", "failed")


@query("SELECT s_suppkey AS station_id, s_name AS station_name, 'city_api' AS source FROM supplier")
def q70_rule_input(spark, d):
    return panels.rule_input(t(spark, d, "supplier"), {"station_id": "s_suppkey", "station_name": "s_name"}, "city_api")


@query("SELECT avg((o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))::INTEGER) AS join_rate FROM orders")
def q71_join_rate(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return panels.join_rate(t(spark, d, "orders"), c, ["o_custkey"])


RIDGE = """f AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, l_shipdate < DATE '1995-06-01' AS train FROM lineitem),
p AS (SELECT avg(x) mx, stddev_pop(x) sx, avg(y) my, count(*) n, covar_pop(x, y) c FROM f WHERE train), w AS (SELECT mx, sx, my, n * (c / sx) / (n + 10.0) AS w FROM p)"""


def ridge_model(spark, d):
    f = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.expr("l_shipdate < DATE '1995-06-01'").alias("train"))
    return f, models.ridge(f.where("train"), ["x"], "y", 10.0)


@query(f"WITH {RIDGE} SELECT l_orderkey, l_linenumber, round(my + w * (x - mx) / sx, 2) AS prediction FROM f, w WHERE NOT train")
def q72_ridge(spark, d):
    f, model = ridge_model(spark, d)
    return model(f.where("not train")).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@query(f"""WITH {RIDGE}, s AS (SELECT unnest([{{'s': 'as_is', 'k': 1.0::DOUBLE, 'b': 0.0::DOUBLE}}, {{'s': 'half', 'k': 0.5, 'b': 0}}, {{'s': 'none', 'k': 0, 'b': -20}}]) AS z)
SELECT z.s AS scenario, round(avg(greatest(my + w * (x * z.k + z.b - mx) / sx, 0)), 2) AS mean_prediction FROM f, w, s WHERE NOT train GROUP BY 1""")
def q73_scenarios(spark, d):
    f, model = ridge_model(spark, d)
    out = models.scenarios(f.where("not train"), model, {"as_is": {}, "half": {"x": F.col("x") * 0.5}, "none": {"x": F.lit(-20.0)}})
    return out.select("scenario", F.round("mean_prediction", 2).alias("mean_prediction"))


@query(f"WITH {PANEL} SELECT 'persistence' AS model, count(*) AS rows, round(avg((next_high = high)::INTEGER), 6) AS accuracy, round(avg(pow(high::INTEGER - next_high::INTEGER, 2)), 6) AS brier FROM labelled WHERE next_high IS NOT NULL")
def q74_persistence(spark, d):
    one = models.classifier_row(models.persistence(labelled(spark, d).where("next_high is not null"), "high"), "persistence", "next_high")
    return one.select("model", "rows", F.round("accuracy", 6).alias("accuracy"), F.round("brier", 6).alias("brier"))


@query("WITH e AS (SELECT value AS v FROM events WHERE value IS NOT NULL), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 r, count(*) OVER () n FROM e) SELECT max(v) AS quantile FROM r WHERE r = ceil(0.9::DOUBLE * (n - 1))")
def q75_whole_quantile(spark, d):
    return agg.higher_quantile(t(spark, d, "events"), "value", [], 0.9)


CELLS = """cells AS (SELECT c_custkey AS k, TIMESTAMP '2024-01-01' + to_hours(c_custkey::INTEGER // 300) + to_minutes(c_custkey::INTEGER % 4) AS captured_at, c_custkey % 4 AS layout,
  CASE WHEN c_custkey % 3 > 0 THEN 'S' || c_custkey END AS short, CASE WHEN c_custkey % 5 = 0 THEN c_name || ', "' || c_mktsegment || '"' || chr(10) || 'gate' ELSE c_name END AS name,
  'g' || c_custkey AS gid, CASE WHEN c_custkey % 7 > 0 THEN (c_nationkey + 10)::VARCHAR END AS cap, CASE WHEN c_custkey % 11 > 0 THEN (c_nationkey % 10)::VARCHAR END AS bikes FROM customer)"""
LAYOUTS = (
    ("station_short_name", "station_name", "gbfs_station_id", "capacity", "num_bikes_available"),
    ("num_bikes_available", "gbfs_station_id", "not known", "station_name"),
    ("station_name", "capacity", "gbfs_station_id", "station_short_name"),
    ("gbfs_station_id", "station_short_name", "capacity", "num_bikes_available", "station_name"),
)


@query(f"""WITH {CELLS} SELECT captured_at, gid AS gbfs_station_id, CASE WHEN layout <> 1 THEN short END AS station_short_name, name AS station_name, CASE WHEN layout <> 1 THEN cap END AS capacity, CASE WHEN layout <> 2 THEN bikes END AS num_bikes_available FROM cells""")
def q76_ragged_snapshots(spark, d):
    """Customers as snapshot files of four layouts, with empty first, inner and last fields, and quotes, commas and line breaks inside fields, read back."""
    k = F.col("c_custkey")
    at = F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, cast(c_custkey div 300 as int), cast(c_custkey % 4 as int))")
    noted = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\ngate'))
    cells = {
        "station_short_name": F.when(k % 3 > 0, F.concat(F.lit("S"), k.cast("string"))), "station_name": F.when(k % 5 == 0, noted).otherwise(F.col("c_name")), "gbfs_station_id": F.concat(F.lit("g"), k.cast("string")),
        "capacity": F.when(k % 7 > 0, (F.col("c_nationkey") + 10).cast("string")), "num_bikes_available": F.when(k % 11 > 0, (F.col("c_nationkey") % 10).cast("string")), "not known": F.lit("x"),
    }
    rows = t(spark, d, "customer").select((k % 4).alias("layout"), F.date_format(at, "yyyyMMdd_HHmmss").alias("captured_stamp"), *[c.alias(n) for n, c in cells.items()])
    folder = sinks.shared_folder(spark)
    for i, layout in enumerate(LAYOUTS):
        sinks.to_snapshots(rows.where(F.col("layout") == i).select("captured_stamp", *layout), folder, "captured_stamp")
    out = readers.snapshot_log(spark, folder)
    return out.select("captured_at", "gbfs_station_id", "station_short_name", "station_name", "capacity", "num_bikes_available")


NIGHT = f"""{CUTS}, sc AS (SELECT hr, next_high AS y, CASE WHEN hr BETWEEN 0 AND 5 THEN value / 125 ELSE value / 100 END AS score, part, event_id FROM parts), gr AS (SELECT unnest({metrics.threshold_grid()!r}::DOUBLE[]) AS threshold),
mt AS (SELECT g.name, threshold, count(*) FILTER (y AND score >= threshold) tp, count(*) FILTER (score >= threshold) said, count(*) FILTER (y) pos FROM sc, gr, (VALUES ('day'), ('night')) g(name) WHERE part = 'calibration' AND (g.name = 'day' OR hr BETWEEN 0 AND 5) GROUP BY ALL),
best AS (SELECT name, threshold FROM mt QUALIFY row_number() OVER (PARTITION BY name ORDER BY coalesce(2 * tp / nullif(said + pos, 0), 0) DESC, coalesce(tp / nullif(said, 0), 0) DESC, abs(threshold - 0.5), threshold) = 1)"""


@query(f"""WITH {NIGHT}, th AS (SELECT max(threshold) FILTER (name = 'day') AS day, max(threshold) FILTER (name = 'night') AS night FROM best)
SELECT event_id, CASE WHEN hr BETWEEN 0 AND 5 THEN night ELSE day END AS threshold, score >= CASE WHEN hr BETWEEN 0 AND 5 THEN night ELSE day END AS predicted FROM sc, th WHERE part = 'test' AND day IS NOT NULL AND night IS NOT NULL""")
def q77_night_thresholds(spark, d):
    """Thresholds of the day and of the hours 0 to 5, chosen on calibration rows whose night scores are lower, put on test rows."""
    rows = parts(spark, d).withColumn("score", F.when(F.col("hr").between(0, 5), F.col("value") / 125).otherwise(F.col("value") / 100))
    chosen = metrics.night_thresholds(rows.where("part = 'calibration'"), "next_high", "score", "hr", metrics.threshold_grid())
    return metrics.by_hour_threshold(rows.where("part = 'test'"), "score", "hr", chosen).select("event_id", "threshold", "predicted")


RIDES = """rides AS (SELECT CASE WHEN event_id % 29 > 0 THEN ts END AS started_at, ts + to_minutes(event_id::INTEGER % 90) AS ended_at, 'S' || user_id % 30 AS sid, CASE WHEN event_id % 31 > 0 THEN 'N' || event_id % 7 END AS sname,
  CASE WHEN event_id % 17 > 0 THEN 'S' || (user_id + event_id) % 30 END AS eid, 37.4::DOUBLE + (user_id % 100) / 500.0::DOUBLE AS lat, 126.8::DOUBLE + (user_id % 77) / 300.0::DOUBLE AS lon FROM events WHERE user_id IS NOT NULL),
ok AS (SELECT * FROM rides WHERE started_at IS NOT NULL AND sname IS NOT NULL), most AS (SELECT sid FROM ok GROUP BY 1 ORDER BY count(*) DESC, sid LIMIT 20), r AS (SELECT * FROM ok WHERE sid IN (SELECT sid FROM most)),
a AS (SELECT sid AS id, date_trunc('hour', started_at) AS hour, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT eid AS id, date_trunc('hour', ended_at) AS hour, count(*) AS n FROM r WHERE eid IN (SELECT sid FROM most) GROUP BY ALL),
places AS (SELECT sid AS id, arg_min(sname, (started_at, sname)) AS sname, median(lat) AS lat, median(lon) AS lon FROM r GROUP BY 1),
known AS (SELECT 'S' || s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS gname, 'g' || s_suppkey AS gid, CASE WHEN s_suppkey % 3 > 0 THEN 37.5::DOUBLE + s_suppkey / 100.0::DOUBLE END AS glat, CASE WHEN s_suppkey % 3 > 0 THEN 127.0::DOUBLE + s_suppkey / 100.0::DOUBLE END AS glon,
  CASE WHEN s_suppkey % 5 > 0 THEN 10 + s_suppkey END::DOUBLE AS cap FROM supplier WHERE s_suppkey < 25),
j AS (SELECT id, coalesce(gname, sname) AS name, gid, coalesce(glat, lat) AS lat, coalesce(glon, lon) AS lon, cap FROM places LEFT JOIN known USING (id)),
m AS (SELECT id, name, gid, lat, lon, coalesce(cap, (SELECT median(cap) FROM j), 20) AS cap, dense_rank() OVER (ORDER BY id) - 1 AS code FROM j),
hs AS (SELECT unnest(generate_series((SELECT min(hour) FROM a), (SELECT max(hour) FROM a), INTERVAL 1 HOUR)) AS hour),
wr AS (SELECT date_trunc('hour', ts) AS hour, max(value) AS level, greatest(max(value) - 75, 0) AS rain FROM events WHERE event_type = 'signup' AND hour(ts) % 3 > 0 GROUP BY 1),
wf AS (SELECT hour, coalesce(last_value(level IGNORE NULLS) OVER p, first_value(level IGNORE NULLS) OVER q) AS level, coalesce(last_value(rain IGNORE NULLS) OVER p, first_value(rain IGNORE NULLS) OVER q) AS rain FROM hs LEFT JOIN wr USING (hour)
  WINDOW p AS (ORDER BY hour ROWS UNBOUNDED PRECEDING), q AS (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT m.*, hs.hour, coalesce(a.n, 0) AS starts, coalesce(b.n, 0) AS ends, level, rain FROM m CROSS JOIN hs LEFT JOIN a ON a.id = m.id AND a.hour = hs.hour LEFT JOIN b ON b.id = m.id AND b.hour = hs.hour JOIN wf ON wf.hour = hs.hour),
w AS (SELECT *, lag(starts, 1) OVER v AS lag_1, lag(starts, 24) OVER v AS lag_24, avg(starts) OVER (v ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS tr FROM f WINDOW v AS (PARTITION BY id ORDER BY hour))"""


@query(f"""WITH {RIDES} SELECT id AS station_short_name, hour, name AS station_name, gid AS gbfs_station_id, round(lat, 6) AS station_lat, round(lon, 6) AS station_lon, cap AS capacity, code::BIGINT AS station_code,
round(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 37.5665) / 2), 2) + cos(radians(37.5665)) * cos(radians(lat)) * pow(sin(radians(lon - 126.978) / 2), 2))), 6) AS distance_to_center_km, starts AS start_count, ends AS end_count, round(level, 6) AS level, round(rain, 6) AS precipitation,
(isodow(hour) - 1)::INTEGER AS weekday, hour(hour)::INTEGER AS hr, (isodow(hour) >= 6)::INTEGER AS is_weekend, (hour(hour) BETWEEN 7 AND 9 OR hour(hour) BETWEEN 16 AND 19)::INTEGER AS is_commute_peak, (hour(hour) BETWEEN 0 AND 5)::INTEGER AS is_night,
coalesce((rain > 0)::INTEGER, 0) AS precipitation_flag, lag_1, lag_24, round(tr, 6) AS rolling_24_mean FROM w WHERE lag_24 IS NOT NULL""")
def q78_station_hour_frame(spark, d):
    """Trips, stations and weather of the given tables: unknown stations, missing places, names and capacities, and hours without weather."""
    e, k = t(spark, d, "events").where("user_id is not null"), F.col("s_suppkey")
    station = lambda x: F.concat(F.lit("S"), (x % 30).cast("string"))
    trips = e.select(
        F.when(F.col("event_id") % 29 > 0, F.col("ts")).alias("started_at"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("ended_at"), station(F.col("user_id")).alias("start_station_id"),
        F.when(F.col("event_id") % 31 > 0, F.concat(F.lit("N"), (F.col("event_id") % 7).cast("string"))).alias("start_station_name"), F.when(F.col("event_id") % 17 > 0, station(F.col("user_id") + F.col("event_id"))).alias("end_station_id"),
        (37.4 + (F.col("user_id") % 100) / 500.0).alias("start_lat"), (126.8 + (F.col("user_id") % 77) / 300.0).alias("start_lng"),
    )
    stations = t(spark, d, "supplier").where(k < 25).select(
        F.concat(F.lit("S"), k.cast("string")).alias("station_short_name"), F.when(k % 4 > 0, F.col("s_name")).alias("station_name"), F.concat(F.lit("g"), k.cast("string")).alias("gbfs_station_id"),
        F.when(k % 3 > 0, 37.5 + k / 100.0).alias("station_lat"), F.when(k % 3 > 0, 127.0 + k / 100.0).alias("station_lon"), F.when(k % 5 > 0, 10 + k).cast("double").alias("capacity"),
    )
    top = F.max("value")
    weather = e.where("event_type = 'signup' and hour(ts) % 3 > 0").groupBy(cal.hour_floor("ts").alias("hour")).agg(top.alias("level"), F.greatest(top - 75, F.lit(0.0)).alias("precipitation"))
    out = panels.station_hour_frame(trips, stations, weather, 20, (37.5665, 126.978), ["level", "precipitation"])
    return out.withColumns({c: F.round(c, 6) for c in ("station_lat", "station_lon", "distance_to_center_km", "level", "precipitation", "rolling_24_mean")})


@query("""WITH h AS (SELECT c_custkey // 60 AS h FROM customer) SELECT count(DISTINCT h) AS source_snapshots, count(DISTINCT CASE WHEN h % 4 <> 1 AND h <= 17 THEN h END) AS snapshots, greatest(count(DISTINCT h) - count(DISTINCT CASE WHEN h % 4 <> 1 AND h <= 17 THEN h END), 0) AS excluded_snapshots FROM h""")
def q79_excluded_snapshots(spark, d):
    """Customers as hourly snapshot files, every fourth without a key in any row, up to a cutoff."""
    hour = F.floor(F.col("c_custkey") / 60).cast("int")
    stamp = F.date_format(F.expr("timestamp_ntz '2024-01-01'") + F.make_dt_interval(hours=hour), "yyyyMMdd_HHmmss")
    rows = t(spark, d, "customer").select(stamp.alias("captured_stamp"), F.when(hour % 4 != 1, F.concat(F.lit("g"), F.col("c_custkey").cast("string"))).alias("gbfs_station_id"), F.col("c_nationkey").alias("capacity"))
    folder = sinks.shared_folder(spark)
    sinks.to_snapshots(rows, folder, "captured_stamp")
    history = readers.snapshot_history(readers.snapshot_log(spark, folder, until="20240101_170000"))
    return readers.excluded_snapshots(spark, folder, history)
