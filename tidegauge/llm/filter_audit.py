"""Filter interaction audit: what each of several filters removes, in every order they could run in.

Only joint-failure counts leave the documents: for each of the 2^k subsets T of the filters, in how many documents of a
part all filters of T fail, J(T), a sum of flag products. All else is Möbius inversion of those sums: documents that pass
all of Q are the sum of (-1)^|T| J(T) over the subsets T of Q, and what fails f but none of P is that sum over J(T + f).
The number of documents that a set of filters removes is a game whose Harsanyi dividend of T is (-1)^(|T|+1) J(T), and a
filter's Shapley value is the sum of its subsets' dividends, each shared equally among |T| filters.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: White space between words, and in a regular expression.
SPACE, SPACES = " \t\n\x0b\x0c\r", "[ \t\n\x0b\x0c\r]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Failures of one text alone: A few words, B repetitive, C shouting, D symbols. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.trim(text, F.lit(SPACE))
    words = F.split(bare, SPACES)
    n = F.when(bare == "", 0).otherwise(F.size(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": (n > 0) & (100 * F.size(F.array_distinct(words)) < 65 * n),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic) of each document; texts don't leave the scan.

    E marks a text that a smaller doc_id has too, told by its SHA-256; a null doc_id comes after all others, rows that
    repeat a doc_id don't mark each other, and a null text is an empty one. good and toxic: some label row of the doc_id has
    quality 1, toxic 1. Columns besides doc_id, text, source and the labels' doc_id, quality and toxic are not read. An empty table stays empty.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", digest.alias("digest"), *[c.alias(k) for k, c in text_flags(F.col("text")).items()])
    marks = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    rows = rows.join(marks, rows["doc_id"] == marks["_id"], "left").drop("_id").fillna(False, ["good", "toxic"])
    # Only texts met more than once are joined back; a text with a third of all rows is split by the adaptive skew join.
    firsts = docs.groupBy(digest.alias("_digest")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    firsts = firsts.where("_n > 1 and _first is not null").drop("_n")
    rows = rows.join(firsts, rows["digest"] == firsts["_digest"], "left")
    later = F.col("_first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_first")))
    return rows.select("part", "A", "B", "C", "D", later.alias("E"), "good", "toxic")


def joint_failures(flags: DataFrame, part: str, filters: list[str], weights: dict[str, Column]) -> DataFrame:
    """Of each part, for each weight an array of J over the subsets of filters as bit masks (bit k: filters[k]), the empty set first; combined before the shuffle."""

    def product(mask: int) -> Column:
        out = F.lit(1).cast("long")
        for k, f in enumerate(filters):
            if mask >> k & 1:
                out = out * F.col(f).cast("long")
        return out

    masks = range(1 << len(filters))
    ones = flags.select(part, *filters, *[w.cast("long").alias(f"w_{name}") for name, w in weights.items()])
    sums = ones.groupBy(part).agg(*[F.sum(product(m) * F.col(f"w_{name}")).alias(f"{name}_{m}") for name in weights for m in masks])
    return sums.select(part, *[F.array(*[F.col(f"{name}_{m}") for m in masks]).alias(name) for name in weights])


def _inverted(joint: Column, filters: int, inside: Column, fixed: Column | None = None, share: int | None = None) -> Column:
    """The sum of (-1)^|T| J(T + fixed) over the subsets T of `inside`, which is apart from `fixed`; with `share`, of share / |T + fixed| times that."""

    fixed = F.lit(0) if fixed is None else fixed

    def add(total: Column, t: Column) -> Column:
        sign = F.when(F.bit_count(t) % 2 == 0, 1).otherwise(-1).cast("long")
        times = 1 if share is None else F.floor(F.lit(share) / F.bit_count(t.bitwiseOR(fixed))).cast("long")
        met = sign * times * F.element_at(joint, t.bitwiseOR(fixed) + 1)
        return total + F.when(t.bitwiseAND(F.bitwise_not(inside)) == 0, met).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), F.lit(0).cast("long"), add)


def interactions(flags: DataFrame, part: str, filters: list[str], lost: dict[str, Column] | None = None) -> DataFrame:
    """A row for each part, order of the filters and step: (filter_order, step, filter, kept, removed, redundant, unique_fails, shapley), and of each weight of `lost` what the step removes.

    `flags` has a boolean column a filter, true where a row fails it (null: passes), of one-letter names. shapley is the
    Shapley value times the number of orders, an integer: removals by the filter over all orders. At most six filters, as
    all orders are listed. A null part is a part of its own.
    """
    k = len(filters)
    if not 1 <= k <= 6 or any(len(f) != 1 for f in filters):
        raise ValueError("one to six filters of one-letter names")
    lost = lost or {}
    known = flags.fillna(False, filters)
    joint = joint_failures(known, part, filters, {"_all": F.lit(1)} | {f"_{name}": F.coalesce(c.cast("long"), F.lit(0)) for name, c in lost.items()})
    orders = F.array(*[F.lit("".join(x)) for x in permutations(filters)])
    rows = joint.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))])
    bit = lambda letter: F.element_at(bits, letter)
    letters = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(F.col("filter_order"), i, F.lit(1)))
    before = F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda m, x: m.bitwiseOR(bit(x)))
    rows = rows.withColumns({"filter": F.element_at(letters, F.col("step")), "_before": before}).withColumn("_own", bit(F.col("filter")))
    full = (1 << k) - 1
    own, earlier, others = F.col("_own"), F.col("_before"), F.lit(full) - F.col("_own")
    removed = _inverted(F.col("_all"), k, earlier, own)
    return rows.select(
        part, "filter_order", "step", "filter", _inverted(F.col("_all"), k, earlier.bitwiseOR(own)).alias("kept"), removed.alias("removed"),
        (F.element_at("_all", own + 1) - removed).alias("redundant"), _inverted(F.col("_all"), k, others, own).alias("unique_fails"),
        *[_inverted(F.col(f"_{name}"), k, earlier, own).alias(name) for name in lost],
        _inverted(F.col("_all"), k, others, own, math.factorial(k)).alias("shapley"),
    )


ORACLE = """
WITH texts AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM texts),
good AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) q, bool_or(coalesce(toxic = 1, false)) x FROM labels GROUP BY 1),
flags AS (
  SELECT part, coalesce(q, false) q, coalesce(x, false) x,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] f
  FROM split LEFT JOIN good USING (doc_id)),
counts AS (SELECT part, f, count(*) n, count(*) FILTER (q) q, count(*) FILTER (x) x FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT *, substr(filter_order, step, 1) "filter", ascii(substr(filter_order, step, 1)) - 64 k,
    [ascii(substr(filter_order, i, 1)) - 64 FOR i IN range(1, step)] before
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER step)),
met AS (
  SELECT part, filter_order, step, "filter", n, q, x, f[k] fails, len(list_filter(before, lambda i: f[i])) > 0 gone, len(list_filter(f, lambda v: v)) = 1 AND f[k] alone
  FROM counts, steps),
rows AS (
  SELECT part, filter_order, step, "filter", sum(n) FILTER (NOT gone AND NOT fails) kept, sum(n) FILTER (fails AND NOT gone) removed, sum(n) FILTER (fails AND gone) redundant,
    sum(n) FILTER (alone) unique_fails, sum(q) FILTER (fails AND NOT gone) good_lost, sum(x) FILTER (fails AND NOT gone) toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, "filter", coalesce(kept, 0)::BIGINT kept, coalesce(removed, 0)::BIGINT removed, coalesce(redundant, 0)::BIGINT redundant, coalesce(unique_fails, 0)::BIGINT unique_fails,
  coalesce(good_lost, 0)::BIGINT good_lost, coalesce(toxic_lost, 0)::BIGINT toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, "filter"), 0)::BIGINT shapley
FROM rows
"""


def op12(spark, sf_dir):
    flags = flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions(flags, "part", list("ABCDE"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
