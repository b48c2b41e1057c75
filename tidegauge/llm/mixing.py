"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sorted_join, table, written

#: Sources up to which their rates are broadcast; beyond that each source is joined in this many parts.
SOURCES, SALTS = 100_000, 64


def poisson_mix(docs: DataFrame, targets: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """Each document repeated by a Poisson count whose mean is its source's repetition rate, shuffled globally.

    The rate of source s is epochs * share(s) * N / n(s) over document counts. Shares come from
    `targets`, scaled to sum to 1 (a source not named gets none); without targets all sources share
    equally. The count inverts the Poisson distribution at a uniform number hashed from seed, doc_id
    and text, so reruns and lost executors give the same rows. Rows that repeat both doc_id and text get equal
    counts and keys; a null doc_id or text hashes as the empty string, so rows without an id differ by their texts; a null
    source is a source of its own, named by None in targets; null and empty texts are mixed like any other; an empty table
    stays empty. Adds rate, copies, replica (1..copies) and shuffle_key, in place of columns of those names; rows
    are dealt out by, and ordered within partitions by, shuffle_key.
    """
    docs = docs.drop("rate", "copies", "replica", "shuffle_key", "_source", "_salt", "_first", "_last", "_log", "_own", "_p")
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sizes = written(docs.groupBy(source.alias("_source")).agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    if targets is None:
        share = 1.0 / F.col("sources")
    else:
        named = {("" if k is None else "=" + k): float(v) / sum(targets.values()) for k, v in targets.items()}
        pairs = [x for k, v in named.items() for x in (F.lit(k), F.lit(v))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0))
    rates = sizes.crossJoin(F.broadcast(total)).select("_source", (epochs * share * F.col("total") / F.col("n")).alias("rate"))
    rates = rates.withColumns(_walk(F.col("rate")))
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    uniform = F.conv(F.substring("_own", 1, 13), 16, 10).cast("double") / float(2**52)
    counted = (
        _with_rates(docs.withColumns({"_source": source, "_own": own}), rates)
        .withColumn("copies", _inverted(uniform))
        .drop("_source", "_first", "_last", "_log")
        .where("copies > 0")
    )
    spread = counted.withColumn("replica", F.explode(F.sequence(F.lit(1), "copies")))
    spread = spread.withColumn("shuffle_key", F.md5(F.concat("_own", F.lit(":"), F.col("replica").cast("string")))).drop("_own")
    return spread.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def _with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs joined to rates by _source: by broadcast where the sources are few, else with each source dealt out over SALTS parts."""
    if rates.limit(SOURCES + 1).count() <= SOURCES:
        return docs.join(F.broadcast(rates), "_source")
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64("_own"), F.lit(SALTS)).cast("int"))
    parts = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sorted_join(salted, parts, ["_source", "_salt"]).drop("_salt")


def _walk(rate: Column) -> dict[str, Column]:
    """Where a walk over the counts begins and ends, and the logarithm of the first one's probability.

    Nine deviations about the mean hold all but 1e-18 of the distribution, so the walk is as long as the root of the
    rate. ln k! is by Stirling's series: where the walk doesn't begin at 0, it begins at 9 or later.
    """
    first = F.floor(rate - 9 * F.sqrt(rate))
    first = F.when(first >= 9, first).otherwise(0).cast("int")
    k = first.cast("double")
    factorial = k * F.log(k) - k + 0.5 * F.log(2 * F.pi() * k) + 1 / (12 * k) - 1 / (360 * F.pow(k, 3)) + 1 / (1260 * F.pow(k, 5)) - 1 / (1680 * F.pow(k, 7))
    log = F.when(first == 0, -rate).otherwise(-rate + k * F.log(rate) - factorial)
    return {"_first": first, "_last": F.ceil(rate + 9 * F.sqrt(rate) + 20).cast("int"), "_log": log}


def _inverted(uniform: Column) -> Column:
    """The number of counts k with P(X <= k) at most `uniform`."""
    start = F.struct(F.exp("_log").alias("p"), F.lit(0.0).alias("sum"), F.col("_first").alias("n"))

    def step(s: Column, k: Column) -> Column:
        total = s["sum"] + s["p"]
        return F.struct((s["p"] * F.col("rate") / (k + 1)).alias("p"), total.alias("sum"), (s["n"] + (total <= uniform).cast("int")).alias("n"))

    return F.aggregate(F.sequence("_first", "_last"), start, step, lambda s: s["n"])


ORACLE = """
WITH sizes AS (SELECT coalesce('=' || source, '') s, count(*) n FROM documents GROUP BY 1),
rates AS (SELECT s, (1.0 * (1.0::DOUBLE / (SELECT count(*) FROM sizes)) * (SELECT sum(n) FROM sizes)::DOUBLE) / n AS rate FROM sizes),
terms AS (SELECT s, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) p FROM rates, generate_series(0, 400) g(k)),
cdf AS (SELECT s, rate, k, sum(p) OVER (PARTITION BY s ORDER BY k) c FROM terms),
o AS (SELECT *, coalesce('=' || source, '') s, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) own FROM documents),
u AS (SELECT *, ('0x' || substr(own, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE u FROM o),
n AS (SELECT u.doc_id, u.source, u.text, own, cdf.rate, count(*) FILTER (c <= u) copies FROM u JOIN cdf USING (s) GROUP BY ALL)
SELECT doc_id, source, text, copies::INTEGER copies, replica::INTEGER replica, md5(own || ':' || replica) shuffle_key
FROM n, LATERAL (SELECT unnest(generate_series(1, copies)) replica)
"""


def op7(spark, sf_dir):
    mixed = poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "text", "copies", "replica", "shuffle_key")
