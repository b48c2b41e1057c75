"""Catalogue queries on demand over time: events, orders and lineitem through the library's operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import clean
from ..operators import aggregate as agg
from ..operators import drift, profile
from ..operators import temporal as tm

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


CUT = "TIMESTAMP_NTZ '2024-01-21 00:00:00'"
SQL_CUT = "TIMESTAMP '2024-01-21 00:00:00'"


@query("""
SELECT event_id, date_trunc('hour', ts) AS hour, (isodow(ts) - 1)::INTEGER AS weekday, (hour(ts) >= 22 OR hour(ts) <= 5) AS is_night,
  isodow(ts) >= 6 AS is_weekend, ((hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19) AND isodow(ts) < 6) AS is_commute FROM events""")
def q01_typed_flags(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", cal.hour_floor("ts").alias("hour"), cal.weekday("ts").alias("weekday"), cal.is_night("ts").alias("is_night"), cal.is_weekend("ts").alias("is_weekend"), cal.is_commute("ts").alias("is_commute"))


def hourly(spark, d) -> DataFrame:
    return t(spark, d, "events").where("user_id is not null").groupBy("user_id", cal.hour_floor("ts").alias("hour")).agg(F.count("*").alias("n"))


HOURLY = "hourly AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {HOURLY} SELECT user_id, hour, n FROM hourly")
def q02_hourly_counts(spark, d):
    return hourly(spark, d)


@query("SELECT user_id, count(*) n, round(sum(value), 4) total, max(value) top, round(median(value), 6) mid FROM events GROUP BY 1")
def q03_multi_aggregate(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top"), F.round(F.median("value"), 6).alias("mid"))


TOP = "top AS (SELECT user_id, count(*) n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT {k})"


@query(f"WITH {TOP.format(k=10)} SELECT * FROM top")
def q04_top_k(spark, d):
    return agg.top_k(t(spark, d, "events"), "user_id", 10)


@query(f"WITH {TOP.format(k=10)} SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM top)")
def q05_semi_top_k(spark, d):
    e = t(spark, d, "events")
    return agg.only_keys(e, agg.top_k(e, "user_id", 10), "user_id").select("event_id", "user_id")


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) p90 FROM events GROUP BY 1")
def q06_p90(spark, d):
    return agg.exact_quantiles(t(spark, d, "events"), "value", ["event_type"], {"p90": 0.9}).withColumn("p90", F.round("p90", 6))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 r, count(*) OVER (PARTITION BY event_type) n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS quantile FROM r WHERE r = ceil(0.9::DOUBLE * (n - 1))""")
def q07_quantile_higher(spark, d):
    return agg.higher_quantile(t(spark, d, "events"), "value", ["event_type"], 0.9)


@query("SELECT (isodow(ts) - 1)::INTEGER AS row, " + ", ".join(f"round(avg(value) FILTER (hour(ts) = {h}), 6) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1")
def q08_pivot_mean(spark, d):
    wide = agg.pivot_mean(t(spark, d, "events"), cal.weekday("ts"), F.hour("ts"), "value", list(range(24)))
    return wide.select("row", *[F.round(F.col(f"`{h}`"), 6).alias(f"h{h}") for h in range(24)])


@query("""WITH s AS (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate))::TIMESTAMP, date_trunc('day', max(o_orderdate))::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM orders),
g AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, sum(o_totalprice) total FROM orders GROUP BY 1)
SELECT day, round(coalesce(total, 0), 2) total FROM s LEFT JOIN g USING (day)""")
def q09_daily_resample(spark, d):
    return agg.daily_sum(t(spark, d, "orders"), "o_orderdate", "o_totalprice").select("day", F.round("total", 2).alias("total"))


SHARES = "SELECT h::INTEGER AS hour, coalesce(n, 0) / (SELECT sum(n) FROM c)::DOUBLE AS share FROM generate_series(0, 23) g(h) LEFT JOIN c ON c.hour = h"


@query(f"WITH c AS (SELECT hour(ts) AS hour, count(*) n FROM events GROUP BY 1) {SHARES}")
def q10_hour_histogram(spark, d):
    return agg.hour_shares(t(spark, d, "events"), "ts")


@query(f"WITH c AS (SELECT hour(ts) AS hour, count(*) n FROM (SELECT DISTINCT date_trunc('minute', ts) ts FROM events) GROUP BY 1) {SHARES}")
def q11_distinct_times(spark, d):
    minutes = t(spark, d, "events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"))
    return agg.hour_shares(minutes, "ts", distinct_times=True)


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) = 1")
def q12_first_row(spark, d):
    return agg.first_rows(t(spark, d, "lineitem"), ["l_orderkey"], LINE).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS bucket,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4.0 WHEN '2-HIGH' THEN 3.0 WHEN '3-MEDIUM' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM orders""")
def q13_case_and_map(spark, d):
    price = F.col("o_totalprice")
    bucket = clean.first_match([(price > 300000, F.lit("large")), (price > 100000, F.lit("middle"))], "small")
    weight = clean.mapped("o_orderpriority", {"1-URGENT": 4.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0}, 1.0)
    return t(spark, d, "orders").select("o_orderkey", bucket.alias("bucket"), weight.alias("weight"))


RAW = "CASE event_id % 8 WHEN 0 THEN ' 12 ' WHEN 1 THEN '3.50' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN 'Yes' WHEN 5 THEN '1e3' WHEN 6 THEN 'true' ELSE CAST(event_id AS VARCHAR(20)) END"


@query(f"""WITH r AS (SELECT event_id, {RAW} AS raw FROM events), f AS (SELECT *, nullif(trim(raw), '') s FROM r),
n AS (SELECT *, CASE WHEN regexp_full_match(s, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(s AS DOUBLE) END x FROM f)
SELECT event_id, s AS as_str, x AS as_float, CASE WHEN x = floor(x) THEN try_cast(x AS BIGINT) END AS as_int,
  coalesce(lower(raw) IN ('true', '1', 'yes', 'y'), false) AS as_flag, lower(trim(raw)) IN ('true', '1', 'yes', 'y') AS as_nullable FROM n""")
def q14_safe_casts(spark, d):
    raw = t(spark, d, "events").select("event_id", F.expr(RAW.replace("VARCHAR(20)", "STRING")).alias("raw"))
    return raw.select(
        "event_id", clean.safe_str("raw").alias("as_str"), clean.safe_float("raw").alias("as_float"), clean.safe_int("raw").alias("as_int"),
        clean.flag("raw").alias("as_flag"), clean.nullable_flag("raw").alias("as_nullable"),
    )


@query("""WITH p AS (SELECT c_custkey, 37.4 + (c_custkey % 100) / 500.0::DOUBLE lat, 126.8 + (c_custkey % 77) / 300.0::DOUBLE lon FROM customer)
SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 37.5665) / 2), 2) + cos(radians(37.5665)) * cos(radians(lat)) * pow(sin(radians(lon - 126.978) / 2), 2))), 6) km FROM p""")
def q15_haversine(spark, d):
    p = t(spark, d, "customer").select("c_custkey", (37.4 + (F.col("c_custkey") % 100) / 500.0).alias("lat"), (126.8 + (F.col("c_custkey") % 77) / 300.0).alias("lon"))
    return p.select("c_custkey", F.round(cal.haversine_km("lat", "lon", 37.5665, 126.978), 6).alias("km"))


@query("SELECT l_returnflag, sum(greatest(l_quantity - 25, 0)) AS plus, sum(abs(least(l_quantity - 25, 0))) AS minus FROM lineitem GROUP BY 1")
def q16_signed_sums(spark, d):
    delta = F.col("l_quantity") - 25
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.greatest(delta, F.lit(0.0))).alias("plus"), F.sum(F.abs(F.least(delta, F.lit(0.0)))).alias("minus"))


@query("SELECT event_id, coalesce(c_mktsegment, 'unknown') AS segment FROM events LEFT JOIN customer ON user_id = c_custkey + 5")
def q17_left_join_default(spark, d):
    c = t(spark, d, "customer").select((F.col("c_custkey") + 5).alias("user_id"), "c_mktsegment")
    return t(spark, d, "events").join(c, "user_id", "left").select("event_id", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


SPINE = f"""{HOURLY}, ends AS (SELECT min(hour) a, max(hour) b FROM hourly), spine AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT user_id FROM hourly), ends)"""


@query(f"WITH {SPINE} SELECT user_id, hour FROM spine")
def q18_dense_spine(spark, d):
    return tm.dense_spine(hourly(spark, d), "user_id", "hour")


@query(f"""WITH {SPINE}, k AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'click') a, count(*) FILTER (event_type = 'purchase') b FROM events GROUP BY 1, 2)
SELECT user_id, hour, coalesce(a, 0) clicks, coalesce(b, 0) purchases FROM spine LEFT JOIN k USING (user_id, hour)""")
def q19_spine_counts(spark, d):
    e = t(spark, d, "events").where("user_id is not null")
    counts = e.groupBy("user_id", cal.hour_floor("ts").alias("hour")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return tm.onto_spine(tm.dense_spine(counts, "user_id", "hour"), counts, ["user_id", "hour"], {"clicks": 0, "purchases": 0})


WEATHER = """ends2 AS (SELECT date_trunc('hour', min(ts)) a, date_trunc('hour', max(ts)) b FROM events), hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM ends2),
w0 AS (SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) v FROM events WHERE event_type = 'signup' GROUP BY 1), w1 AS (SELECT hour, v FROM hours LEFT JOIN w0 USING (hour)),
weather AS (SELECT hour, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w1)"""


def weather(spark, d) -> DataFrame:
    e = t(spark, d, "events").select(cal.hour_floor("ts").alias("hour"), "event_type", "value")
    level = e.where("event_type = 'signup'").groupBy("hour").agg(F.round(F.avg("value"), 6).alias("level"))
    return tm.filled(tm.time_spine(e, "hour").join(level, "hour", "left"), ["level"], ["hour"])


@query(f"WITH {WEATHER} SELECT hour, level FROM weather")
def q20_fill_both_ways(spark, d):
    return weather(spark, d)


@query(f"""WITH {TOP.format(k=20)}, {SPINE}, {WEATHER},
f AS (SELECT s.user_id, s.hour, coalesce(h.n, 0) n, level FROM spine s LEFT JOIN hourly h USING (user_id, hour) LEFT JOIN weather USING (hour) WHERE s.user_id IN (SELECT user_id FROM top)),
w AS (SELECT *, lag(n, 1) OVER v lag_1, lag(n, 24) OVER v lag_24, avg(n) OVER (v ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) trailing_24 FROM f WINDOW v AS (PARTITION BY user_id ORDER BY hour))
SELECT user_id, hour, n, level, lag_1, lag_24, trailing_24, hour(hour)::INTEGER AS hr, (isodow(hour) - 1)::INTEGER AS weekday FROM w WHERE lag_24 IS NOT NULL""")
def q21_entity_hour_frame(spark, d):
    h = hourly(spark, d)
    spine = agg.only_keys(tm.dense_spine(h, "user_id", "hour"), agg.top_k(t(spark, d, "events"), "user_id", 20), "user_id")
    f = tm.onto_spine(spine, h, ["user_id", "hour"], {"n": 0}).join(weather(spark, d), "hour", "left")
    f = tm.trailing_mean(tm.lags(f, "n", [1, 24], ["hour"], ["user_id"]), "n", 24, ["hour"], ["user_id"], least=12)
    return f.dropna(subset=["lag_24"]).select("user_id", "hour", "n", "level", "lag_1", "lag_24", "trailing_24", F.hour("hour").alias("hr"), cal.weekday("hour").alias("weekday"))


PARTS = f"{HOURLY}, p AS (SELECT *, hour(hour)::INTEGER hr, (isodow(hour) - 1)::INTEGER weekday FROM hourly), train AS (SELECT * FROM p WHERE hour < {SQL_CUT}), target AS (SELECT * FROM p WHERE hour >= {SQL_CUT})"
CHAIN = f"""{PARTS}, p0 AS (SELECT user_id, weekday, hr, median(n) m FROM train GROUP BY ALL), p1 AS (SELECT user_id, hr, median(n) m FROM train GROUP BY ALL), p2 AS (SELECT hr, median(n) m FROM train GROUP BY ALL),
scored AS (SELECT g.user_id, g.hour, g.n, coalesce(p0.m, p1.m, p2.m, (SELECT median(n) FROM train)) AS profile FROM target g
  LEFT JOIN p0 ON g.user_id = p0.user_id AND g.weekday = p0.weekday AND g.hr = p0.hr LEFT JOIN p1 ON g.user_id = p1.user_id AND g.hr = p1.hr LEFT JOIN p2 ON g.hr = p2.hr)"""


def profiled(spark, d) -> DataFrame:
    p = hourly(spark, d).withColumns({"hr": F.hour("hour"), "weekday": cal.weekday("hour")})
    train, target = p.where(f"hour < {CUT}"), p.where(f"hour >= {CUT}")
    return profile.profile_chain(train, target, [["user_id", "weekday", "hr"], ["user_id", "hr"], ["hr"]], "n").select("user_id", "hour", "n", "profile")


@query(f"WITH {CHAIN} SELECT user_id, hour, n, profile FROM scored")
def q22_profile_chain(spark, d):
    return profiled(spark, d)


@query(f"""WITH e AS (SELECT *, hour(ts)::INTEGER hr, event_type = 'purchase' AS y FROM events), tr AS (SELECT * FROM e WHERE ts < {SQL_CUT}), r AS (SELECT user_id, hr, avg(y::INTEGER) rate FROM tr GROUP BY ALL),
a AS (SELECT avg(y::INTEGER) a FROM tr) SELECT event_id, coalesce(rate, a) AS rate, least(0.5, greatest(0.1, a))::DOUBLE AS threshold, coalesce(rate, a) >= least(0.5, greatest(0.1, a)) AS predicted
FROM e LEFT JOIN r USING (user_id, hr), a WHERE ts >= {SQL_CUT}""")
def q23_profile_rate(spark, d):
    e = t(spark, d, "events").withColumns({"hr": F.hour("ts"), "y": F.col("event_type") == "purchase"})
    return profile.profile_rate(e.where(f"ts < {CUT}"), e.where(f"ts >= {CUT}"), ["user_id", "hr"], "y").select("event_id", "rate", "threshold", "predicted")


@query("SELECT avg((user_id IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02' AND user_id IS NOT NULL))::INTEGER) AS membership_rate FROM events WHERE ts >= TIMESTAMP '2024-01-02'")
def q24_membership_rate(spark, d):
    e = t(spark, d, "events")
    cut = "TIMESTAMP_NTZ '2024-01-02 00:00:00'"
    return drift.membership_rate(e.where(f"ts >= {cut}"), e.where(f"ts < {cut}"), "user_id")


@query("""SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS without_orders FROM customer""")
def q25_semi_and_anti(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("with_orders"))
    return a.crossJoin(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("without_orders")))


DAILY = "daily AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS n FROM orders GROUP BY 1)"


def daily(spark, d) -> DataFrame:
    return t(spark, d, "orders").groupBy(cal.day_floor("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH {DAILY}, w AS (SELECT *, lag(n, 1) OVER v lag_1, lag(n, 7) OVER v lag_7, avg(n) OVER (v ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) trailing_7,
avg(n) OVER (v ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) trailing_28, row_number() OVER v r FROM daily WINDOW v AS (ORDER BY day)) SELECT day, n, lag_1, lag_7, trailing_7, trailing_28 FROM w WHERE r > 28""")
def q26_global_lags(spark, d):
    return tm.series_features(daily(spark, d), "n", [1, 7], {7: None, 28: None}, ["day"]).na.drop("any")


@query(f"""WITH {SPINE}, f AS (SELECT s.user_id, s.hour, coalesce(h.n, 0)::BIGINT n FROM spine s LEFT JOIN hourly h USING (user_id, hour)),
w AS (SELECT *, lag(n, 1) OVER v lag_1, lag(n, 24) OVER v lag_24, avg(n) OVER (v ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) trailing_24 FROM f WINDOW v AS (PARTITION BY user_id ORDER BY hour))
SELECT * FROM w WHERE lag_24 IS NOT NULL""")
def q27_entity_lags(spark, d):
    h = hourly(spark, d)
    f = tm.onto_spine(tm.dense_spine(h, "user_id", "hour"), h, ["user_id", "hour"], {"n": 0})
    f = tm.lags(f, "n", [1, 24], ["hour"], ["user_id"])
    return tm.trailing_mean(f, "n", 24, ["hour"], ["user_id"], least=12).dropna(subset=["lag_24"]).select("user_id", "hour", "n", "lag_1", "lag_24", "trailing_24")


PANEL = """panel AS (SELECT *, value > 50 AS high, lead(ts) OVER v AS next_ts, lead(value > 50) OVER v AS raw, (epoch_us(lead(ts) OVER v) - epoch_us(ts)) / 6e7 AS gap_minutes FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id)),
labelled AS (SELECT *, CASE WHEN gap_minutes <= 90 THEN raw END AS next_high FROM panel)"""


def labelled(spark, d) -> DataFrame:
    return tm.next_state(t(spark, d, "events").withColumn("high", F.col("value") > 50), "user_id", "ts", ["high"], 90.0, ["event_id"])


@query(f"WITH {PANEL} SELECT event_id, next_ts, gap_minutes, next_high FROM labelled")
def q28_next_state(spark, d):
    return labelled(spark, d).select("event_id", "next_ts", "gap_minutes", "next_high")


CHRONO = """r AS (SELECT day, row_number() OVER (ORDER BY day) r, count(*) OVER () n FROM daily),
parts AS (SELECT day, CASE WHEN r <= greatest(floor(n * 0.7::DOUBLE), 1) THEN 'train' WHEN r <= greatest(floor(n * 0.85::DOUBLE), 1) THEN 'valid' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {DAILY}, {CHRONO} SELECT split, count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM orders JOIN parts ON day = date_trunc('day', o_orderdate) GROUP BY 1")
def q29_chronological_split(spark, d):
    o = t(spark, d, "orders").select(cal.day_floor("o_orderdate").alias("day"))
    return tm.chronological_split(o, "day").groupBy("split").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


HOURS = "times AS (SELECT hour, row_number() OVER (ORDER BY hour) r, count(*) OVER () n FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events))"


@query(f"WITH {HOURS}, s AS (SELECT hour, CASE WHEN r <= floor(n * 0.75::DOUBLE) THEN 'train' ELSE 'test' END split FROM times) SELECT split, count(*) AS rows FROM events JOIN s ON hour = date_trunc('hour', ts) GROUP BY 1")
def q30_temporal_split(spark, d):
    e = t(spark, d, "events").select(cal.hour_floor("ts").alias("hour"))
    return tm.temporal_split(e, "hour", 0.25).groupBy("split").agg(F.count("*").alias("rows"))


@query(f"""WITH {HOURS}, p AS (SELECT DISTINCT n, floor(n * 0.5)::BIGINT f, (n - floor(n * 0.5)::BIGINT) // 3 AS s FROM times), k AS (SELECT k::INTEGER AS fold, f + (k - 1) * s AS a, CASE WHEN k = 3 THEN n ELSE f + k * s END AS b FROM p, generate_series(1, 3) g(k)),
c AS (SELECT date_trunc('hour', ts) AS hour, count(*) m FROM events GROUP BY 1)
SELECT fold, sum(m) FILTER (r <= a)::BIGINT AS train_rows, sum(m) FILTER (r > a)::BIGINT AS test_rows, max(hour) FILTER (r <= a) AS train_end, max(hour) AS test_end FROM k, times JOIN c USING (hour) WHERE r <= b GROUP BY 1""")
def q31_rolling_folds(spark, d):
    e = t(spark, d, "events").select(cal.hour_floor("ts").alias("hour"))
    counts = e.groupBy("hour").agg(F.count("*").alias("m")).join(F.broadcast(tm.fold_bounds(e, "hour", 3, 0.5)), F.col("hour") <= F.col("test_end"))
    train = F.col("hour") <= F.col("train_end")
    return counts.groupBy("fold").agg(F.sum(F.when(train, F.col("m"))).alias("train_rows"), F.sum(F.when(~train, F.col("m"))).alias("test_rows"), F.max(F.when(train, F.col("hour"))).alias("train_end"), F.max("hour").alias("test_end"))


@query("WITH c AS (SELECT count(*) n FROM orders) SELECT k::INTEGER AS fold, n - (6 - k) * (n // 6) AS train_rows, n // 6 AS test_rows FROM c, generate_series(1, 5) g(k)")
def q32_row_folds(spark, d):
    return tm.row_folds(t(spark, d, "orders"), ["o_orderkey"], 5)
