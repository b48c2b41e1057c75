"""Catalogue queries on stock, rules, metrics, drift and gates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import aggregate as agg
from ..operators import drift, gates, metrics
from ..operators import inventory as inv
from ..operators import temporal as tm
from .demand_queries import CHAIN, LINE, PANEL, labelled, profiled, t

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


KEYS = ["l_orderkey", *LINE]
#: Capacities from 10 up, more units than fit, and both sides short in some rows.
RULED = """stock AS (SELECT *, 10 + l_partkey % 30 AS capacity, l_quantity::BIGINT % 14 AS units, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 3 ELSE greatest(10 + l_partkey % 30 - l_quantity::BIGINT % 14, 0) END AS room FROM lineitem),
gaps AS (SELECT *, greatest(1, ceil(capacity * 0.1::DOUBLE)) AS lim, greatest(greatest(1, ceil(capacity * 0.1::DOUBLE)) - units, 0) AS ug, greatest(greatest(1, ceil(capacity * 0.1::DOUBLE)) - room, 0) AS rg FROM stock),
severe AS (SELECT *, ug / lim + greatest(0, 1 - units / capacity) AS us, rg / lim + greatest(0, 1 - room / capacity) AS rs FROM gaps),
told AS (SELECT *, CASE WHEN ug > 0 AND us >= rs THEN 'stock_shortage' WHEN rg > 0 THEN 'space_shortage' ELSE 'balanced' END AS issue FROM severe),
every AS (SELECT *, CASE issue WHEN 'stock_shortage' THEN 'send' WHEN 'space_shortage' THEN 'remove' ELSE 'monitor' END AS action,
  round_even(CASE issue WHEN 'stock_shortage' THEN us WHEN 'space_shortage' THEN rs ELSE greatest(abs(units / capacity - 0.5), abs(room / capacity - 0.5)) * 0.1::DOUBLE END, 6) AS severity,
  CASE issue WHEN 'stock_shortage' THEN greatest(ceil(capacity * 0.2::DOUBLE) - units, 1)::BIGINT WHEN 'space_shortage' THEN -greatest(units - floor(capacity * 0.8::DOUBLE), 1)::BIGINT ELSE 0 END AS delta FROM told),
ruled AS (SELECT * FROM every WHERE issue <> 'balanced')"""


def stock(spark, d):
    capacity, units = 10 + F.col("l_partkey") % 30, F.col("l_quantity").cast("long") % 14
    room = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey") % 3).otherwise(F.greatest(capacity - units, F.lit(0)))
    return t(spark, d, "lineitem").withColumns({"capacity": capacity, "units": units, "room": room})


def ruled(spark, d):
    return inv.rebalancing(stock(spark, d), "capacity", "units", "room")


ORDER = f"severity DESC, abs(delta) DESC, {', '.join(KEYS)}"


@query(f"WITH {RULED} SELECT l_orderkey, l_linenumber, l_partkey, issue, action, severity, delta FROM ruled")
def q33_severity_rules(spark, d):
    return ruled(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "issue", "action", "severity", "delta")


@query(f"WITH {RULED} SELECT issue, action, severity, delta, count(*) AS rows, min(capacity) AS least_capacity FROM every GROUP BY ALL")
def q33_balanced_too(spark, d):
    """Every distinct outcome of the rule, balanced rows too: those where both sides are short, and where a stock gap is outweighed."""
    out = inv.rebalancing(stock(spark, d), "capacity", "units", "room", balanced=True)
    return out.groupBy("issue", "action", "severity", "delta").agg(F.count("*").alias("rows"), F.min("capacity").alias("least_capacity"))


@query(f"WITH {RULED} SELECT l_orderkey, l_linenumber, severity, delta, row_number() OVER (ORDER BY {ORDER})::INTEGER AS rank FROM ruled ORDER BY rank LIMIT 50")
def q34_top_global(spark, d):
    return inv.top_global(ruled(spark, d), 50, *KEYS).select("l_orderkey", "l_linenumber", "severity", "delta", "rank")


@query(f"WITH {RULED} SELECT l_shipdate, l_orderkey, severity, row_number() OVER (PARTITION BY l_shipdate ORDER BY {ORDER})::INTEGER AS rank FROM ruled QUALIFY rank <= 5")
def q35_top_per_snapshot(spark, d):
    return inv.top_per_group(ruled(spark, d), "l_shipdate", 5, *KEYS).select("l_shipdate", "l_orderkey", "severity", "rank")


@query(f"""WITH {RULED}, r AS (SELECT *, row_number() OVER (PARTITION BY l_shipdate, action ORDER BY {ORDER})::INTEGER AS action_rank FROM ruled)
SELECT l_shipdate, action, l_orderkey, action_rank FROM r WHERE action_rank <= CASE action WHEN 'send' THEN 2 ELSE 3 END""")
def q36_top_balanced(spark, d):
    return inv.top_balanced(ruled(spark, d), "l_shipdate", 5, *KEYS).select("l_shipdate", "action", "l_orderkey", "action_rank")


HITS = f"""nexts AS (SELECT *, lead(l_quantity::BIGINT % 14 <= 5) OVER v AS next_low, lead(CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 3 ELSE greatest(10 + l_partkey % 30 - l_quantity::BIGINT % 14, 0) END <= 5) OVER v AS next_full FROM lineitem WINDOW v AS (PARTITION BY l_partkey ORDER BY l_shipdate, {', '.join(k for k in KEYS if k != 'l_shipdate')})),
{RULED.replace('FROM lineitem', 'FROM nexts')}, r AS (SELECT *, row_number() OVER (PARTITION BY l_shipdate ORDER BY {ORDER}) rk, row_number() OVER (PARTITION BY l_shipdate, action ORDER BY {ORDER}) ak,
  coalesce(CASE WHEN issue = 'stock_shortage' THEN next_low ELSE next_full END, false) hit FROM ruled),
picked AS (SELECT l_shipdate, k, mode, hit, action FROM r, (VALUES (4), (10)) a(k), (VALUES ('global'), ('balanced')) b(mode)
  WHERE CASE WHEN mode = 'global' THEN rk <= k ELSE ak <= CASE action WHEN 'send' THEN k // 2 ELSE k - k // 2 END END),
each AS (SELECT l_shipdate, k, mode, count(*) predictions, count(*) FILTER (hit) hits, count(*) FILTER (action = 'send') send_count, count(*) FILTER (action = 'send' AND hit) send_hits,
  count(*) FILTER (action = 'remove') remove_count, count(*) FILTER (action = 'remove' AND hit) remove_hits FROM picked GROUP BY ALL)"""


def labelled_stock(spark, d):
    s = stock(spark, d).withColumns({"low": F.col("units") <= 5, "full": F.col("room") <= 5})
    return tm.next_state(s, "l_partkey", "l_shipdate", ["low", "full"], None, [k for k in KEYS if k != "l_shipdate"])


def precision(spark, d):
    return inv.rule_precision(inv.rebalancing(labelled_stock(spark, d), "capacity", "units", "room"), "l_shipdate", [4, 10], "next_low", "next_full", *KEYS)


@query(f"WITH {HITS} SELECT l_shipdate, k, mode, predictions, hits, send_count, send_hits, remove_count, remove_hits, hits / predictions AS precision FROM each")
def q37_rule_precision(spark, d):
    return precision(spark, d)


@query(f"WITH {HITS} SELECT k, mode, count(DISTINCT l_shipdate) AS groups, sum(predictions)::BIGINT AS predictions, sum(hits)::BIGINT AS hits, sum(hits) / sum(predictions) AS precision FROM each GROUP BY ALL")
def q37_micro_precision(spark, d):
    return inv.micro_precision(precision(spark, d), "l_shipdate")


@query(f"""WITH {HITS}, base AS (SELECT count(DISTINCT l_shipdate) AS snapshots, count(DISTINCT CASE WHEN next_low IS NOT NULL OR next_full IS NOT NULL THEN l_shipdate END) AS label_snapshots, count(next_low) AS label_rows FROM nexts),
g AS (SELECT count(DISTINCT l_shipdate) AS evaluated_snapshots, coalesce(sum(predictions) FILTER (k = 4), 0)::BIGINT AS predictions_at_4, coalesce(sum(hits) FILTER (k = 4), 0)::BIGINT AS hits_at_4, coalesce(sum(predictions) FILTER (k = 10), 0)::BIGINT AS predictions_at_10, coalesce(sum(hits) FILTER (k = 10), 0)::BIGINT AS hits_at_10,
  coalesce(sum(send_count) FILTER (k = 10), 0)::BIGINT AS send_count, coalesce(sum(send_hits) FILTER (k = 10), 0)::BIGINT AS send_hits, coalesce(sum(remove_count) FILTER (k = 10), 0)::BIGINT AS remove_count, coalesce(sum(remove_hits) FILTER (k = 10), 0)::BIGINT AS remove_hits FROM each WHERE mode = 'global'),
b AS (SELECT coalesce(sum(send_count), 0)::BIGINT AS balanced_send_count, coalesce(sum(send_hits), 0)::BIGINT AS balanced_send_hits, coalesce(sum(remove_count), 0)::BIGINT AS balanced_remove_count, coalesce(sum(remove_hits), 0)::BIGINT AS balanced_remove_hits, sum(hits) / nullif(sum(predictions), 0) AS balanced_precision_at_10 FROM each WHERE mode = 'balanced' AND k = 10)
SELECT *, hits_at_4 / nullif(predictions_at_4, 0) AS precision_at_4, hits_at_10 / nullif(predictions_at_10, 0) AS precision_at_10, send_hits / nullif(send_count, 0) AS send_precision, remove_hits / nullif(remove_count, 0) AS remove_precision,
  balanced_send_hits / nullif(balanced_send_count, 0) AS balanced_send_precision, balanced_remove_hits / nullif(balanced_remove_count, 0) AS balanced_remove_precision, evaluated_snapshots / greatest(label_snapshots, 1) AS coverage,
  CASE WHEN snapshots >= 1000 AND evaluated_snapshots > 0 THEN 'READY' ELSE 'NOT_READY' END AS status, CASE WHEN evaluated_snapshots > 0 THEN 'EVALUATED' ELSE 'NOT_EVALUATED' END AS evaluation FROM base, g, b""")
def q37_rule_summary(spark, d):
    return inv.rule_summary(labelled_stock(spark, d), precision(spark, d), "l_shipdate", "next_low", "next_full", [4, 10], 1000)


BUCKET = "CASE WHEN hr BETWEEN 7 AND 9 THEN 'morning' WHEN hr BETWEEN 17 AND 19 THEN 'evening' WHEN hr >= 22 OR hr <= 5 THEN 'night' WHEN hr < 12 THEN 'forenoon' ELSE 'afternoon' END"
PRIORITY = "CASE bucket WHEN 'morning' THEN 4.0 WHEN 'evening' THEN 4.0 WHEN 'night' THEN 1.0 ELSE 2.0 END"


@query(f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) n FROM events GROUP BY 1), b AS (SELECT n, {BUCKET.replace('hr', 'hour(hour)')} AS bucket FROM h),
g AS (SELECT bucket, ceil(0.55 * median(n + 3) + 0.25 * max(n))::BIGINT AS target FROM b GROUP BY 1), m AS (SELECT *, {PRIORITY}::DOUBLE AS priority, floor(target * 0.35)::BIGINT AS least FROM g),
w AS (SELECT *, greatest(sum(least) OVER ()::DOUBLE, sum(target) OVER () * 0.82::DOUBLE) - sum(least) OVER () AS spare,
  coalesce(sum(target - least) OVER (ORDER BY priority DESC, target DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM m)
SELECT bucket, target, least, round(least + least((target - least)::DOUBLE, greatest(0, spare - taken)), 6) AS allocated FROM w""")
def q38_allocation(spark, d):
    h = t(spark, d, "events").groupBy(cal.hour_floor("ts").alias("hour")).agg(F.count("*").alias("n"))
    b = h.withColumns({"hr": F.hour("hour")}).selectExpr("n", "n + 3 as upper", f"{BUCKET} as bucket")
    targets = inv.demand_targets(b, "bucket", "n", "upper").withColumn("priority", F.expr(PRIORITY).cast("double"))
    return inv.allocate(targets, "bucket", "target", "priority").select("bucket", "target", "least", F.round("allocated", 6).alias("allocated"))


@query(f"""WITH {CHAIN}, e AS (SELECT n::DOUBLE y, profile p, n - profile e FROM scored) SELECT round(avg(abs(e)), 6) mae, round(sqrt(avg(e * e)), 6) rmse, round(100 * avg(abs(e) / greatest(abs(y), 1)), 6) mape,
round(100 * avg(2 * abs(e) / greatest(abs(y) + abs(p), 1)), 6) smape, round(100 * sum(abs(e)) / greatest(sum(abs(y)), 1), 6) wape, round(1 - sum(e * e) / (var_pop(y) * count(y)), 6) r2 FROM e""")
def q39_regression_metrics(spark, d):
    one = profiled(spark, d).agg(*metrics.regression_metrics("n", "profile"))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


@query("""WITH e AS (SELECT l_suppkey AS grp, (l_quantity::BIGINT % 4)::DOUBLE / 2 AS y, l_discount * 20 AS p FROM lineitem WHERE l_orderkey % 40 > 0 OR l_suppkey > 5 UNION ALL SELECT -1, 0, l_discount FROM lineitem WHERE l_orderkey = 1),
m AS (SELECT grp, y, p, y - p AS e FROM e) SELECT grp, round(avg(abs(e)), 6) mae, round(sqrt(avg(e * e)), 6) rmse, round(100 * avg(abs(e) / greatest(abs(y), 1)), 6) mape, round(100 * avg(2 * abs(e) / greatest(abs(y) + abs(p), 1)), 6) smape,
round(100 * sum(abs(e)) / greatest(sum(abs(y)), 1), 6) wape, round(1 - sum(e * e) / nullif(var_pop(y) * count(y), 0), 6) r2 FROM m GROUP BY 1""")
def q39_metrics_of_small_values(spark, d):
    """Values of 0, a half, 1 and one and a half against predictions from 0 up, by group, and a group whose values are all 0."""
    lines = t(spark, d, "lineitem")
    some = lines.where("l_orderkey % 40 > 0 or l_suppkey > 5").select(F.col("l_suppkey").alias("grp"), ((F.col("l_quantity").cast("long") % 4) / 2).alias("y"), (F.col("l_discount") * 20).alias("p"))
    none = lines.where("l_orderkey = 1").select(F.lit(-1).cast("long").alias("grp"), F.lit(0.0).alias("y"), F.col("l_discount").alias("p"))
    out = some.union(none).groupBy("grp").agg(*metrics.regression_metrics("y", "p"))
    return out.select("grp", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("""WITH o AS (SELECT *, isodow(o_orderdate) >= 6 AS weekend FROM orders), s AS (SELECT unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN weekend THEN 'weekend' END, CASE WHEN NOT weekend THEN 'workday' END,
CASE WHEN o_totalprice > 300000 THEN 'large' END], lambda x: x IS NOT NULL)) AS segment, o_totalprice FROM o) SELECT segment, count(*) AS rows, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM s GROUP BY 1""")
def q40_segments(spark, d):
    weekend = cal.is_weekend("o_orderdate")
    segments = {"all": F.lit(True), "weekend": weekend, "workday": ~weekend, "large": F.col("o_totalprice") > 300000}
    return agg.by_segment(t(spark, d, "orders"), segments, F.count("*").alias("rows"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(agg.quantile("o_totalprice", 0.9), 4).alias("p90"))


@query(f"""WITH {PANEL}, c AS (SELECT count(*) FILTER (next_high AND high) tp, count(*) FILTER (NOT next_high AND high) fp, count(*) FILTER (next_high AND NOT high) fn, count(*) n, avg((next_high = high)::INTEGER) accuracy FROM labelled WHERE next_high IS NOT NULL)
SELECT n AS rows, accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def q41_classification_metrics(spark, d):
    return labelled(spark, d).where("next_high is not null").agg(*metrics.classification_metrics("next_high", "high"))


@query("""WITH l AS (SELECT toxic = 1 AS y, (doc_id % 10) / 10 AS score FROM labels), s AS (SELECT score, sum(y::INTEGER) pos, count(*) n FROM l GROUP BY 1), r AS (SELECT pos, sum(pos) OVER w tp, sum(n) OVER w seen FROM s WINDOW w AS (ORDER BY score DESC))
SELECT round((SELECT sum(pos * tp / seen) / sum(pos) FROM r), 6) AS average_precision, round((SELECT avg(pow(score - y::INTEGER, 2)) FROM l), 6) AS brier""")
def q42_average_precision(spark, d):
    rows = t(spark, d, "labels").select((F.col("toxic") == 1).alias("y"), ((F.col("doc_id") % 10) / 10).alias("score"))
    ap = metrics.average_precision(rows, "y", "score").select(F.round("average_precision", 6).alias("average_precision"))
    b = rows.agg(metrics.brier("y", "score")).select(F.round("brier", 6).alias("brier"))
    return ap.crossJoin(b)


@query(f"""WITH {CHAIN}, c AS (SELECT abs(n - profile) r FROM scored WHERE hour < TIMESTAMP '2024-01-25'), k AS (SELECT r, row_number() OVER (ORDER BY r) - 1 i, count(*) OVER () n FROM c),
q AS (SELECT max(r) radius FROM k WHERE i = ceil(least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1)))
SELECT user_id, hour, greatest(0, profile - radius) AS lower, profile + radius AS upper, n BETWEEN greatest(0, profile - radius) AND profile + radius AS covered FROM scored, q WHERE hour >= TIMESTAMP '2024-01-25'""")
def q43_conformal(spark, d):
    early = F.col("hour") < F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")
    return metrics.conformal_intervals(profiled(spark, d), "n", "profile", early).select("user_id", "hour", "lower", "upper", "covered")


PSI = """ed AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) q FROM events WHERE ts < TIMESTAMP '2024-01-16'),
bn AS (SELECT ts < TIMESTAMP '2024-01-16' AS ref, len(list_filter(q[2:len(q) - 1], lambda x: x <= value)) AS bin, len(q) AS k FROM events, ed), bc AS (SELECT bin, count(*) FILTER (ref) a, count(*) FILTER (NOT ref) b FROM bn GROUP BY 1),
sh AS (SELECT greatest(coalesce(a, 0) / (SELECT sum(a) FROM bc), 1e-6) p, greatest(coalesce(b, 0) / (SELECT sum(b) FROM bc), 1e-6) q FROM generate_series(0, (SELECT len(q) - 2 FROM ed)) g(i) LEFT JOIN bc ON bin = i),
psi AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM sh)"""


@query(f"WITH {PSI} SELECT round(psi, 6) AS psi FROM psi")
def q44_psi(spark, d):
    e = t(spark, d, "events")
    return drift.psi(e, "value", early()).select(F.round("psi", 6).alias("psi"))


def early():
    return F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")


def _tv(rows: str, name: str) -> str:
    return f"""{name} AS (SELECT 0.5 * sum(abs(coalesce(a, 0) / (SELECT sum(a) FROM {name}_h) - coalesce(b, 0) / (SELECT sum(b) FROM {name}_h))) AS v FROM generate_series(0, 23) g(h) LEFT JOIN {name}_h ON hr = h)""", f"""{name}_h AS (SELECT hour(ts) hr, count(*) FILTER (ts < TIMESTAMP '2024-01-16') a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') b FROM ({rows}) GROUP BY 1)"""


TV_ROWS, TV_ROWS_H = _tv("SELECT ts FROM events", "tv_rows")
TV_TIMES, TV_TIMES_H = _tv("SELECT DISTINCT date_trunc('minute', ts) ts FROM events", "tv_times")


@query(f"WITH {TV_ROWS_H}, {TV_ROWS}, {TV_TIMES_H}, {TV_TIMES} SELECT round(tv_rows.v, 6) AS by_rows, round(tv_times.v, 6) AS by_times FROM tv_rows, tv_times")
def q45_hour_distance(spark, d):
    e = t(spark, d, "events").select("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"))
    a, b = e.where(early()), e.where(~early())
    rows = drift.hour_distance(a, b, "ts").select(F.round("hour_distance", 6).alias("by_rows"))
    minutes = lambda x: x.select(F.col("minute").alias("ts"))
    return rows.crossJoin(drift.hour_distance(minutes(a), minutes(b), "ts", True).select(F.round("hour_distance", 6).alias("by_times")))


@query(f"""WITH {PSI}, {TV_ROWS_H}, {TV_ROWS}, y AS (SELECT abs(avg((value > 50)::INTEGER) FILTER (ts < TIMESTAMP '2024-01-16') - avg((value > 50)::INTEGER) FILTER (ts >= TIMESTAMP '2024-01-16')) v FROM events),
m AS (SELECT avg((user_id IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16'))::INTEGER) v FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
x AS (SELECT 'rate_difference' AS "check", v AS value, 0.1 AS "limit", 'max' AS direction FROM y UNION ALL SELECT 'psi', psi, 0.25, 'max' FROM psi UNION ALL SELECT 'hour_distance', v, 0.2, 'max' FROM tv_rows UNION ALL SELECT 'membership_rate', v, 0.95, 'min' FROM m)
SELECT "check", round(value, 6) AS value, "limit"::DOUBLE AS "limit", direction, CASE WHEN CASE direction WHEN 'max' THEN value <= "limit" ELSE value >= "limit" END THEN 'PASS' ELSE 'FAIL' END AS status FROM x""")
def q46_drift_table(spark, d):
    e = t(spark, d, "events").withColumn("y", F.col("value") > 50)
    return drift.drift_table(e, early(), "ts", "user_id", "value", "y").withColumn("value", F.round("value", 6))


GRID = metrics.threshold_grid()
GRID_SQL = f"""l AS (SELECT toxic = 1 AS y, (doc_id % 10) / 10 AS score FROM labels), g AS (SELECT unnest({GRID!r}::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (y AND score >= threshold) tp, count(*) FILTER (score >= threshold) said, count(*) FILTER (y) pos FROM l, g GROUP BY 1),
m AS (SELECT threshold, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(2 * tp / nullif(said + pos, 0), 0) AS f1 FROM c)"""


def grid(spark, d):
    rows = t(spark, d, "labels").select((F.col("toxic") == 1).alias("y"), ((F.col("doc_id") % 10) / 10).alias("score"))
    return metrics.threshold_metrics(rows, "y", "score", GRID)


@query(f"WITH {GRID_SQL} SELECT * FROM m")
def q47_threshold_grid(spark, d):
    return grid(spark, d)


@query(f"WITH {GRID_SQL} SELECT * FROM m ORDER BY f1 DESC, precision DESC, abs(threshold - 0.5), threshold LIMIT 1")
def q47_best_threshold(spark, d):
    return metrics.best_threshold(grid(spark, d))


@query("""SELECT quality, count(*) AS rows, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic <> 1) AS negatives, avg((toxic = 1)::INTEGER) AS rate, count(*) FILTER (toxic = 1) / greatest(count(*) FILTER (toxic <> 1), 1) AS pos_neg_ratio FROM labels GROUP BY 1""")
def q48_class_balance(spark, d):
    return metrics.class_balance(t(spark, d, "labels").withColumn("y", F.col("toxic") == 1), "y", ["quality"])


@query(f"""WITH {PANEL}, c AS (SELECT hour(ts)::INTEGER AS hour, count(*) AS rows, avg(next_high::INTEGER) AS rate, avg((high <> next_high)::INTEGER) AS transition_rate, count(*) FILTER (next_high AND high) tp, count(*) FILTER (high) said, count(*) FILTER (next_high) pos FROM labelled WHERE next_high IS NOT NULL GROUP BY 1)
SELECT hour, rows, rate, transition_rate, coalesce(tp / nullif(said, 0), 0) AS now_precision, coalesce(tp / nullif(pos, 0), 0) AS now_recall, coalesce(2 * tp / nullif(said + pos, 0), 0) AS now_f1 FROM c""")
def q48_hour_diagnostics(spark, d):
    return metrics.hour_diagnostics(labelled(spark, d).where("next_high is not null"), "ts", "next_high", "high", {"now": "high"})


@query("""WITH e AS (SELECT event_id AS row_key, nullif(trim(props ->> '$.k'), '') AS k FROM events) SELECT row_key, 'k' AS field, CASE WHEN k IS NULL THEN 'missing' WHEN NOT regexp_full_match(k, '-?[0-9]+') THEN 'wrong_type' ELSE 'out_of_range' END AS issue FROM e
WHERE k IS NULL OR NOT regexp_full_match(k, '-?[0-9]+') OR NOT try_cast(k AS DOUBLE) BETWEEN 0 AND 90""")
def q49_json_contract(spark, d):
    e = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return gates.contract_issues(e, "event_id", [gates.FieldRule("k", "int", 0, 90)])


@query("""WITH s AS (SELECT l_partkey, CASE WHEN l_partkey % 11 > 0 THEN max(l_quantity) % 20 END AS units, min(l_quantity) AS room FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1),
sized AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size END::DOUBLE AS size FROM part)
SELECT p_partkey, p_size, ceil(greatest(p_size * 0.1::DOUBLE, 1))::BIGINT AS threshold, coalesce(units <= ceil(greatest(p_size * 0.1::DOUBLE, 1)), false) AS stock_short, coalesce(room <= ceil(greatest(p_size * 0.1::DOUBLE, 1)), false) AS space_short,
1 - units / greatest(p_size, 1) AS pressure, units IS NOT NULL AS has_status FROM (SELECT p_partkey, coalesce(size, (SELECT median(size) FROM sized)) AS p_size FROM sized) LEFT JOIN s ON p_partkey = l_partkey""")
def q50_inventory_snapshot(spark, d):
    lines = t(spark, d, "lineitem").where("l_partkey % 7 <> 0")
    status = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_quantity") % 20).alias("units"), F.min("l_quantity").alias("room"))
    status = status.withColumn("units", F.when(F.col("p_partkey") % 11 > 0, F.col("units")))
    key = F.col("p_partkey")
    meta = t(spark, d, "part").select("p_partkey", F.when(key % 17 == 0, F.when(key % 13 > 0, F.lit(0))).when(key % 13 > 0, F.col("p_size")).cast("double").alias("p_size"))
    out = inv.inventory_snapshot(meta, status, "p_partkey", "p_size", "units", "room", ["p_size"])
    return out.select("p_partkey", "p_size", "threshold", "stock_short", "space_short", "pressure", "has_status")


@query("""SELECT count(*) AS rows, count(DISTINCT c_nationkey) AS keys, count(c_nationkey) - count(DISTINCT c_nationkey) AS repeated, count(c_acctbal) AS c_acctbal_filled, round(sum(c_acctbal), 2) AS c_acctbal_total,
concat_ws(',', CASE WHEN count(*) < 10 THEN 'too_few_rows' END, CASE WHEN count(c_nationkey) > count(DISTINCT c_nationkey) THEN 'repeated_keys' END, CASE WHEN count(c_acctbal) < count(*) THEN 'missing_c_acctbal' END) AS errors,
NOT (count(*) < 10 OR count(c_nationkey) > count(DISTINCT c_nationkey) OR count(c_acctbal) < count(*)) AS ok FROM customer""")
def q51_inventory_summary(spark, d):
    out = gates.inventory_summary(t(spark, d, "customer"), "c_nationkey", ["c_acctbal"], 10)
    return out.withColumn("c_acctbal_total", F.round("c_acctbal_total", 2))


READY = f"""{PANEL}, h AS (SELECT *, date_trunc('hour', ts) AS cap FROM labelled WHERE {{when}}), s AS (SELECT min(cap) AS first_at, max(cap) AS last_at, (epoch_us(max(cap)) - epoch_us(min(cap))) / 86400e6 AS span_days, count(DISTINCT cap) AS snapshots, count(DISTINCT user_id) AS entities,
count(*) AS rows, count(next_high) AS labels, avg(next_high::INTEGER) AS label_rate, avg(high::INTEGER) AS high_rate FROM h),
ready AS (SELECT *, 268 AS needed_snapshots, greatest(268 - snapshots, 0) AS remaining_snapshots, least(snapshots / 336, 1) AS coverage, first_at + INTERVAL 14 DAY AS earliest_ready_at, coalesce(snapshots >= 268 AND span_days >= 14 AND labels > 0, false) AS ready,
  CASE WHEN snapshots = 0 THEN 'no snapshots' WHEN snapshots >= 268 AND span_days >= 14 AND labels > 0 THEN 'ready' ELSE 'waiting for more snapshots' END AS reason FROM s)"""
EARLY, READY = READY.format(when="ts < TIMESTAMP '2024-01-05'"), READY.format(when="true")


def readiness(spark, d, when: str = "true"):
    return gates.readiness(labelled(spark, d).where(when).withColumn("at", cal.hour_floor("ts")), "at", "user_id", "next_high", states=["high"])


@query(f"WITH {READY} SELECT * FROM ready")
def q52_readiness(spark, d):
    return readiness(spark, d)


@query(f"WITH {EARLY} SELECT * FROM ready")
def q52_not_ready_yet(spark, d):
    return readiness(spark, d, "ts < TIMESTAMP_NTZ '2024-01-05 00:00:00'")


@query(f"WITH {EARLY.replace('2024-01-05', '2023-01-01')} SELECT * FROM ready")
def q52_no_history(spark, d):
    return readiness(spark, d, "ts < TIMESTAMP_NTZ '2023-01-01 00:00:00'")


@query(f"""WITH {READY} SELECT 'enough_snapshots' AS gate, snapshots >= 268 AS passed, snapshots::VARCHAR AS evidence, '>= 268' AS threshold FROM ready UNION ALL SELECT 'enough_labels', labels >= 1000000, labels::VARCHAR, '>= 1000000' FROM ready
UNION ALL SELECT 'many_entities', entities >= 10, entities::VARCHAR, '>= 10' FROM ready""")
def q53_gate_table(spark, d):
    return gate_rows(spark, d)


def gate_rows(spark, d):
    return gates.gate_table(
        readiness(spark, d),
        [("enough_snapshots", F.col("snapshots") >= 268, "snapshots", ">= 268"), ("enough_labels", F.col("labels") >= 1_000_000, "labels", ">= 1000000"), ("many_entities", F.col("entities") >= 10, "entities", ">= 10")],
    )


@query(f"WITH {READY}, g AS (SELECT snapshots >= 268 a, labels >= 1000000 b, entities >= 10 c FROM ready) SELECT a AND b AND c AS all_passed, concat_ws(',', CASE WHEN NOT b THEN 'enough_labels' END, CASE WHEN NOT a THEN 'enough_snapshots' END, CASE WHEN NOT c THEN 'many_entities' END) AS failed, CASE WHEN a AND b AND c THEN 'GO' ELSE 'NO_GO' END AS decision FROM g")
def q53_gate_decision(spark, d):
    return gates.gate_decision(gate_rows(spark, d))


POINTS = f"""{RULED}, one AS (SELECT l_partkey, issue FROM ruled QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER}) = 1),
places AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 37.0 + p_partkey % 10 END AS lat, CASE WHEN p_partkey % 3 <> 0 THEN 127.0 + p_partkey % 10 END AS lon FROM part),
points AS (SELECT p_partkey, lat::DOUBLE AS lat, lon::DOUBLE AS lon, coalesce(issue, 'balanced') AS issue, CASE issue WHEN 'stock_shortage' THEN 'red' WHEN 'space_shortage' THEN 'blue' ELSE 'green' END AS colour FROM places LEFT JOIN one ON p_partkey = l_partkey WHERE lat IS NOT NULL AND lon IS NOT NULL)"""


def points(spark, d):
    key = F.col("p_partkey")
    places = t(spark, d, "part").select("p_partkey", F.when(key % 5 != 0, 37.0 + key % 10).alias("lat"), F.when(key % 3 != 0, 127.0 + key % 10).alias("lon"))
    rules = ruled(spark, d).withColumnRenamed("l_partkey", "p_partkey")
    tie = [k if k != "l_partkey" else "p_partkey" for k in KEYS]
    return inv.map_points(places, rules, "p_partkey", "lat", "lon", inv.severity_order(*tie)).select("p_partkey", "lat", "lon", "issue", "colour")


@query(f"WITH {POINTS} SELECT * FROM points")
def q54_map_points(spark, d):
    return points(spark, d)


@query(f"WITH {POINTS} SELECT colour, count(*) AS n FROM points GROUP BY 1")
def q54_point_counts(spark, d):
    return points(spark, d).groupBy("colour").agg(F.count("*").alias("n"))
