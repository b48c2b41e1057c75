"""Stupid-backoff language-model scores from n-gram counts over all documents.

The count table is partitioned by n-gram hash. Documents are dealt into chunks of bounded size; a
chunk's distinct n-grams, sorted, go to the count partitions as packed rows (one for each chunk
and partition), where the counts of all chunks are summed; the sums return to the chunks in the
same order, and each chunk joins them to its exploded n-grams and sums their log scores for each
document. So an n-gram costs one entry for each chunk that has it, however frequent it is. N-grams are
known by 61-bit hashes alone: two that share one share their counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Characters of text in a chunk, and chunks to a partition of the count table; packed rows are chunks times partitions at most, and never more than entries.
CHUNK, CHUNKS = 3_000_000, 8
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TAG = np.uint64(7)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of words of the texts, and for each order 1 to `order` the hashes of n-grams at each word of all texts: those that end there.

    The lowest three bits of a hash are its order; it is zero where the text has fewer words before.
    """
    get = _Words().__getitem__
    ids = [np.fromiter(map(get, (t or "").encode("utf-8", "surrogatepass").split()), np.uint64) for t in texts]
    size = np.array([len(x) for x in ids], np.int64)
    word = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out, raw = [], word
    for n in range(1, order + 1):
        if n > 1:
            raw = np.r_[np.uint64(0), raw[:-1]][: len(word)] * _BASE + word
            raw = (raw ^ (raw >> np.uint64(31))) * _MIX
            raw ^= raw >> np.uint64(30)
        out.append(np.where(place >= n - 1, (raw & ~_TAG) | np.uint64(n), np.uint64(0)))
    return size, out


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of hashes begins in sorted keys."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def _narrow(x: np.ndarray) -> bytes:
    """Small numbers in as many bytes as the largest needs; the first byte says how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(x.max(initial=0)) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """(doc_id, n_words, log_score): the summed natural log of S(word | words before) over each row of docs.

    Words are what ASCII white space separates. S is count(n-gram) / count(its first n - 1 words) at the longest
    order that the text has words for, if the n-gram was counted min_count times or more; otherwise alpha
    times S one order down; single words score count / all words. Counts are over all rows, the
    scored one too; orders above one that were counted less often are left out as too rare. A null or wordless text has no
    words and log_score 0. Rows that repeat count as often as they stand. An empty table gives no rows.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(chars / CHUNK))
    parts = math.ceil(chunks / CHUNKS)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))
    dealt = docs.select("doc_id", "text", chunk.alias("chunk"))

    def count(t: pa.Table) -> pa.Table:
        _, grams = ngrams(t.column("text").to_pylist(), order)
        keys, n = np.unique(np.concatenate(grams), return_counts=True)
        keys, n = keys[keys > 0], n[keys > 0]
        cut = _cuts(keys, parts).tolist()
        rows = [(p, keys[a:b].tobytes(), _narrow(n[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        own = t.column("chunk")[0].as_py()
        return pa.table([[own] * len(rows), [r[0] for r in rows], pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["chunk", "part", "keys", "n"]).cast(
            pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
        )

    counted = dealt.groupBy("chunk").applyInArrow(count, "chunk long, part int, keys binary, n binary")

    def total(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in t.column("keys").to_pylist()]
        n = np.concatenate([_wide(x) for x in t.column("n").to_pylist()])
        all_keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, n).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        back = [_narrow(x) for x in np.split(sums[inverse], ends[:-1])]
        single = int(sums[(all_keys & _TAG) == 1].sum())
        singles = pa.array([single] + [0] * (len(keys) - 1), pa.int64())
        return pa.table({"chunk": t.column("chunk"), "part": t.column("part"), "sums": pa.array(back, pa.binary()), "words": singles})

    totals = written(counted.groupBy("part").applyInArrow(total, "chunk long, part int, sums binary, words long"))
    words = max(1, totals.agg(F.sum("words")).first()[0] or 0)

    def score(docs: pa.Table, sums: pa.Table) -> pa.Table:
        size, grams = ngrams(docs.column("text").to_pylist(), order)
        keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        by_part = dict(zip(sums.column("part").to_pylist(), sums.column("sums").to_pylist()))
        counts = np.concatenate([np.zeros(int(len(keys) > 0 and keys[0] == 0), np.int64), *(_wide(by_part[p]) for p in sorted(by_part))])
        c = counts[inverse].reshape(order, -1) if len(keys) else np.zeros((order, 0), np.int64)
        log_s = np.log(np.maximum(c[0], 1) / words)
        for n in range(1, order):
            context = np.r_[1, c[n - 1][:-1]][: c.shape[1]]
            has = grams[n] > 0
            seen = np.log(np.maximum(c[n], 1) / np.maximum(context, 1))
            log_s = np.where(has, np.where(c[n] >= min_count, seen, math.log(alpha) + log_s), log_s)
        ends = np.cumsum(size)
        each = [float(log_s[a:b].sum()) for a, b in zip((ends - size).tolist(), ends.tolist())]
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(size), "log_score": pa.array(each, pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d), g AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS before FROM p),
one AS (SELECT w, count(*) AS n FROM g GROUP BY 1), two AS (SELECT before, w, count(*) AS n FROM g WHERE before IS NOT NULL GROUP BY ALL),
s AS (SELECT r, CASE WHEN two.n >= 2 THEN ln(two.n / prior.n) ELSE ln(CASE WHEN g.before IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * one.n / (SELECT count(*) FROM g)) END AS log
  FROM g JOIN one USING (w) LEFT JOIN one AS prior ON prior.w = g.before LEFT JOIN two ON two.before = g.before AND two.w = g.w)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce((SELECT sum(log) FROM s WHERE s.r = d.r), 0), 3) AS log_score FROM d
"""


def op5(spark, sf_dir):
    """Bigrams, whose counts fit the disk of the check; scores to three digits."""
    out = stupid_backoff(table(spark, sf_dir, "documents"), order=2)
    return out.withColumn("log_score", F.round("log_score", 3))
