"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sorted_join, table, written
from .components import components

BITS = 64
#: Fingerprints, about, of which pairs are sampled to estimate candidates.
SAMPLE = 1_500
#: Buckets of more fingerprints than the first are linked as a forest, in one task each; those that more than the second probe, through shared neighbours.
BUCKET, GROUP = 64, 20_000


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 values of the `width`-word shingles, repeats included.

    A-Z are lower-cased and words split at ASCII white space. Fewer words than `width` make one
    shingle of them all; no words (or null) make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it; zero for none. As a signed integer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: str | None, width: int, seed: int = 42) -> int:
    return fingerprint(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; whole texts, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(t.as_py(), width, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and a 64 x 64 matrix of how many have both bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in np.array_split(x, len(x) // (1 << 15) + 1):
                m = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += m.T @ m
            n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, i], pa.int32()), pa.array(np.r_[-1, j], pa.int32()), pa.array(np.r_[n, both.ravel()].astype(np.int64))], ["i", "j", "n"]
        )

    summed = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, n = np.zeros((BITS, BITS)), 0
    for r in summed.collect():  # 4,097 rows at any size
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of nearly equal width, correlated bits together (greedily, by absolute correlation)."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def sampled_pairs(fps: DataFrame, n: int) -> np.ndarray:
    """The differing bits of each two of a sample of about SAMPLE fingerprints, those of least hash, twice as many at most. It steers cost, never the result."""
    share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40))
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < share).limit(2 * SAMPLE).toArrow()
    x = some.column("fp").to_numpy().view(np.uint64)
    i, j = np.triu_indices(len(x), 1)
    return x[i] ^ x[j]


def estimated_costs(n: int, apart: np.ndarray, bits: list[int], most: int) -> dict[int, float]:
    """For each radius from -1 (not probed) to `most`, the rows that a partition costs: probes, and candidate pairs estimated from how sampled pairs differ in its bits."""
    differ = np.bitwise_count(apart & np.uint64(sum(1 << b for b in bits)))
    near = np.cumsum(np.bincount(differ, minlength=most + 1))
    balls = itertools.accumulate(math.comb(len(bits), d) for d in range(most + 1))
    n = max(n, 1)
    return {-1: 0.0} | {r: n * ball + n * n * (int(near[r]) + 1) / (len(apart) + 1) for r, ball in enumerate(balls)}


def allocate(n: int, both: np.ndarray, apart: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds t >= -1 with sum(t + 1) = tau + 1, of least estimated cost.

    Two fingerprints within tau bits differ by at most t in some partition. Thresholds come from
    dynamic programming over partitions; the number of partitions is the cheapest of 2 to tau + 1.
    """
    best = None
    for parts in range(2 if tau else 1, tau + 2):
        groups = group_bits(n, both, parts)
        plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            costs = estimated_costs(n, apart, g, tau)
            grown: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in plans.items():
                for t in range(-1, tau - used + 1):
                    c = cost + costs[t]
                    if used + t + 1 not in grown or c < grown[used + t + 1][0]:
                        grown[used + t + 1] = (c, [*ts, t])
            plans = grown
        cost, ts = plans[tau + 1]
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, ts)))
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _ball(bits, radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for d in range(radius + 1) for c in itertools.combinations(bits, d)]


def forest(fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) links, fewer than the distinct fingerprints (as uint64), that connect all that are within tau bits of each other."""
    left, out = np.arange(len(fps)), []
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            by = np.full(len(left), -1)
            for at in range(0, len(edge), 256):
                part, free = edge[at : at + 256], np.flatnonzero(by < 0)
                near = np.bitwise_count(fps[left[free]] ^ fps[part][:, None]) <= tau
                hit = near.any(axis=0)
                by[free[hit]] = part[near[:, hit].argmax(axis=0)]
            edge = left[by >= 0]
            out.append((edge, by[by >= 0]))
            left = left[by < 0]
    a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    return fps[a], fps[b]


def _grouped_links(met: DataFrame, tau: int) -> DataFrame:
    """(a, b) from (part, key, fp): each bucket's forest."""

    def run(t: pa.Table) -> pa.Table:
        a, b = forest(np.unique(t.column("fp").to_numpy().view(np.uint64)), tau)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return met.groupBy("part", "key").applyInArrow(run, "a long, b long")


def _neighbour_links(fps: DataFrame, tau: int) -> DataFrame:
    """(a, b): fingerprints within tau bits share a value within tau / 2 of both, and two that share one are within tau."""
    around = F.array(*[F.lit(f) for f in _ball(range(BITS), tau // 2)])
    values = fps.select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    first = values.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("value", "b")
    return sorted_join(values, first, "value").where("fp <> b").select("fp", "b")


def near_links(fps: DataFrame, tau: int, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """(a, b) links that connect exactly the distinct fingerprints (column fp) within tau bits of each other; tau is even.

    Probing a bucket of at most `bucket` fingerprints and verifying gives its links themselves. A
    larger bucket that at most `group` fingerprints probe is linked in one task as a forest of verified
    links; beyond that, fingerprints are linked through the values around them. So no bucket
    is paired with itself in full and no link is lost.
    """
    if tau % 2:
        raise ValueError("tau must be even")
    n, both = bit_statistics(fps)
    plan = [(k, bits, t) for k, (bits, t) in enumerate(allocate(n, both, sampled_pairs(fps, n), tau)) if t >= 0]
    masks = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(_signed(sum(1 << b for b in bits))).alias("mask")) for k, bits, _ in plan])
    index = fps.select("fp", F.explode(masks).alias("m")).select("m.part", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")
    full = written(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("part", "key"))
    flips = [(k, f) for k, bits, t in plan for f in _ball(bits, t)]
    if len(flips) > len(plan):
        steps = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(f).alias("flip")) for k, f in flips])
        probe = index.select("fp", "part", "key", F.explode(steps).alias("s")).where("s.part = part")
        probe = probe.select("part", F.col("key").bitwiseXOR(F.col("s.flip")).alias("key"), "fp")
    else:
        probe = index
    small = index.join(full, ["part", "key"], "left_anti").withColumnRenamed("fp", "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau
    a, b = probe.alias("p"), small.alias("s")
    apart = F.col("fp") < F.col("other") if probe is index else F.col("fp") != F.col("other")
    links = sorted_join(a, b, (F.col("p.part") == F.col("s.part")) & (F.col("p.key") == F.col("s.key")) & apart & near).select(
        F.col("fp").alias("a"), F.col("other").alias("b")
    )
    met = written(probe.join(full, ["part", "key"], "left_semi"))
    huge = written(met.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("part", "key"))
    grouped = _grouped_links(met.join(huge, ["part", "key"], "left_anti"), tau)
    return links.union(grouped).union(_neighbour_links(met.join(huge, ["part", "key"], "left_semi").select("fp").distinct(), tau))


def near_duplicates(docs: DataFrame, width: int = 5, tau: int = 2, seed: int = 42, least: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs, of columns doc_id and text.

    Documents link where fingerprints of `width`-word shingles differ by at most tau bits (an even number);
    component_id is the smallest doc_id reachable over links. Equal fingerprints (copies, ties, repeated rows, all
    texts without words) are collapsed to one first. A null doc_id gets a component but never names one
    while the component has another id. An empty table gives an empty result. With `least` (a decimal number, and seed 42), texts
    link where the Jaccard similarity of their shingles is that or more, all of them: see shingles.similar_groups.
    """
    if least is not None:
        from .shingles import similar_groups

        return similar_groups(docs, width, least, tau)
    rows = written(fingerprints(docs, width, seed))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = written(near_links(fps.select("fp"), tau))
    groups = components(links)
    named = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op6(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), width=3, tau=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
