"""SimHash near-duplicates held to a true Jaccard similarity of word shingles, and completed to all pairs that have it.

Sixty-four bits can't tell a similarity of 0.8: fingerprints of such texts differ by ten bits or so, which no
partition of 64 bits can be probed for. So fingerprints within a few bits, which link most near copies at
little cost, are candidates whose shingles are compared; what they leave apart is searched for by the
shingles themselves. Two sets of the similarity share a shingle among the first of either, in one order of all shingles.
Sets are not stored: what is kept of each is those first shingles and a sketch, a bit or two for each shingle, which
rules most other candidates out; shingles of the sets that are left are made from their texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared, sorted_join, written
from .components import components
from .simhash import fingerprint, near_links, shingle_hashes

#: One shingle set in SAMPLE tells which shingles are common: those that more than COMMON of these have, the
#: MOST most common at most. They come last in every prefix; which they are changes the cost, never the result.
SAMPLE, COMMON, MOST = 8, 1, 2_000_000
#: Sets that share a leading shingle are paired with each other up to this many; more are linked through pivots, in so many rounds of so many, before pairs are made.
PAIRED, ROUNDS, PIVOTS = 64, 2, 2
#: Names of sets, sent to every task to choose them from all sets; more are joined, which moves all sets' shingles.
SENT = 2_000_000
#: Rows whose shingles a task holds at once.
ROWS = 1_000
#: 64-bit words of the smallest sketch, a power of two; sets that share a shingle of many are held against each other by so many.
WORDS = 8


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))


def sketch(s: np.ndarray) -> np.ndarray:
    """Bit i of a power of two says whether an odd number of the set's shingles are i modulo it. Bits that differ between two sets are no more than the shingles that do."""
    bits = 64 * max(WORDS, 1 << max(0, 2 * len(s) - 1).bit_length() >> 6)
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch as one of fewer words, a power of two."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def possible(x: np.ndarray, y: np.ndarray, sizes: int, least: Fraction) -> bool:
    """Whether sketches allow the similarity to two sets of so many shingles together."""
    words = min(len(x), len(y))
    apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
    return apart * (least.denominator + least.numerator) <= sizes * (least.denominator - least.numerator)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("mark"), "text")


def _sets(docs: DataFrame, width: int, least: Fraction) -> DataFrame:
    """(doc_id, mark, key, fp, size, sketch, heads): a hash of the text, a 128-bit hash that names its shingle set, the text's fingerprint, the set's size and sketch, and its prefix."""
    sent = shared(docs.sparkSession, _common(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent()
        for b in _slices(batches):
            every = [shingle_hashes(t.as_py(), width) for t in b.column(2)]
            sets = [np.unique(h) for h in every]
            columns = [b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(map(fingerprint, every), pa.int64())]
            columns += [pa.array(map(len, sets), pa.int32()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())]
            heads = [prefix(s, common, least).view(np.int64) for s in sets]
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "key", "fp", "size", "sketch", "heads"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, key binary, fp long, size int, sketch binary, heads array<long>")


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles, and how many sampled texts have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            h = np.concatenate([np.unique(shingle_hashes(t.as_py(), width)) for t in b.column(0)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    some = _marked(docs).where(F.pmod("mark", F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > COMMON)
    kept = written(counts.orderBy(F.desc("n"), "h").limit(MOST))
    t = kept.toArrow()
    discard(kept)
    h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: Fraction) -> np.ndarray:
    """The first shingles of a set, rare ones first, then by hash: two sets of similarity `least` or more share one."""
    h, n = common
    at = np.minimum(np.searchsorted(h, s), max(len(h) - 1, 0))
    df = np.where(h[at] == s, n[at], 0) if len(h) else np.zeros(len(s), np.int64)
    return s[np.lexsort((s, df))][: len(s) - -(-len(s) * least.numerator // least.denominator) + 1]


def _postings(rows: DataFrame) -> DataFrame:
    """(h, k, size, rest) for each shingle of each prefix; rest is how many shingles of the set are left with it."""
    each = rows.where("size > 0").select(F.xxhash64("key").alias("k"), "size", F.posexplode("heads").alias("at", "h"))
    return each.select("h", "k", "size", (F.col("size") - F.col("at")).alias("rest"))


def _allowed(least: Fraction):
    """Whether rows x and y of one shingle can have the similarity by their sizes, and by what is left of both from it on; all that have it pass at the first shingle they share."""
    num, den = least.numerator, least.denominator
    a, b, left = F.col("x.size"), F.col("y.size"), F.least("x.rest", "y.rest")
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (left * (num + den) >= (a + b) * num)


def _alike(least: Fraction):
    """Whether the sketches of rows x and y, of WORDS words, allow the similarity."""
    apart = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(WORDS)), F.lit(0))
    return apart * (least.denominator + least.numerator) <= (F.col("x.size") + F.col("y.size")) * (least.denominator - least.numerator)


def _met(x: DataFrame, y: DataFrame, least: Fraction, and_also: str) -> DataFrame:
    """Distinct (a, b), a < b, of rows x and y that share a shingle and can have the similarity, by their sketches too where they have these."""
    can = _allowed(least) & F.expr(and_also)
    if "sketch" in x.columns and "sketch" in y.columns:
        can = can & _alike(least)
    pairs = sorted_join(x.alias("x"), y.alias("y"), (F.col("x.h") == F.col("y.h")) & can)
    return pairs.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).where("a < b").distinct()


def _chosen(sets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the sets that are in pairs (a, b) of k, and those k, written, which are sent to the tasks while there are no more than SENT of them."""
    ks = written(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
    return sets.join(F.broadcast(ks) if ks.count() <= SENT else ks, "k", "left_semi"), ks


def _of_pairs(sets: DataFrame, pairs: DataFrame, whole: Callable[[DataFrame], DataFrame] = lambda own: own) -> DataFrame:
    """(k, key, hashes) of the sets that are in pairs (a, b) of k, each once, as `whole` makes them of the rows of these."""
    own, ks = _chosen(sets, pairs)
    out = written(whole(own).select("k", "key", "hashes").dropDuplicates(["key"]))
    discard(ks)
    return out


def _from_texts(docs: DataFrame, width: int) -> Callable[[DataFrame], DataFrame]:
    """What makes (k, key, hashes) of sets (k, key, mark), from the texts of these marks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["key", "hashes"])

    def whole(own: DataFrame) -> DataFrame:
        own = written(own.select("k", "key", "mark"))
        marks = own.select("mark").distinct()
        texts = _marked(docs).join(F.broadcast(marks) if own.count() <= SENT else marks, "mark", "left_semi")
        return texts.select("text").distinct().mapInArrow(run, "key binary, hashes binary").join(own.select("k", "key"), "key")

    return whole


def _likely(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Those of distinct pairs (a, b) of k whose sketches allow the similarity, written. Where sets share a k, any of them may."""
    own, ks = _chosen(sets.select("k", "size", "sketch"), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _slices(batches):
            words = [[np.frombuffer(x.as_py(), np.uint64) for x in c] for c in r.columns[3:]]
            ok = pa.array([possible(x, y, n, least) for x, y, n in zip(*words, r.column(2).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in r.columns[:2]], ["a", "b"])

    first, second = own.toDF("a", "size_a", "x"), own.toDF("b", "size_b", "y")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), "x", "y")
    out = written(both.mapInArrow(run, "a long, b long").distinct())
    discard(ks)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): keys of the sets of pairs (a, b) of k that have the similarity, written. Sets that share a k are each compared."""
    met = written(pairs)
    pairs = _likely(met, sets, least)
    discard(met)
    if pairs.isEmpty():
        discard(pairs)
        return pairs.sparkSession.range(1).where("false").select(F.lit(b"").alias("a"), F.lit(b"").alias("b"))
    own = _of_pairs(sets, pairs, whole)
    first = own.select(F.col("k").alias("a"), F.col("key").alias("key_a"), F.col("hashes").alias("x"))
    second = own.select(F.col("k").alias("b"), F.col("key").alias("key_b"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _slices(batches):
            ok = np.zeros(r.num_rows, bool)
            for i, (x, y) in enumerate(zip(r.column(2), r.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = both * least.denominator >= (len(x) + len(y) - both) * least.numerator
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in r.columns[:2]], ["a", "b"])

    out = written(pairs.join(first, "a").join(second, "b").select("key_a", "key_b", "x", "y").mapInArrow(run, "a binary, b binary"))
    discard(pairs, own)
    return out


def _by_fingerprint(sets: DataFrame, tau: int) -> DataFrame:
    """(a, b): k of one fingerprint, each with the least of them, and those least ones where fingerprints are within tau bits."""
    ks = sets.select("k", "fp").distinct()
    fps = written(ks.groupBy("fp").agg(F.min("k").alias("head")))
    same = ks.join(fps, "fp").where("k <> head").select("head", "k")
    near = near_links(fps.select("fp"), tau)
    near = near.join(fps.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    both = same.union(near.select("x", "y")).toDF("x", "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(heavy: DataFrame, stars: DataFrame) -> DataFrame:
    """heavy with each k's component (its own without one) and whether that is not the shingle's largest (minor), but for shingles all of whose sets are in one."""
    found = stars.select(F.xxhash64("node").alias("k"), F.xxhash64("component").alias("component"))
    named = heavy.join(found, "k", "left").withColumn("component", F.coalesce("component", "k"))
    sizes = named.groupBy("h", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("components")).where("components > 1")
    return written(named.join(largest, "h").withColumn("minor", F.col("component") != F.col("largest")).drop("largest", "components"))


def _pivots(now: DataFrame, salts: range) -> DataFrame:
    """(h, k, size, rest): for each salt the set of least hash in the largest component of shingle h."""
    each = [F.min_by(F.struct("k", "size", "rest"), F.xxhash64(F.lit(salt), "k")) for salt in salts]
    chosen = now.where("not minor").groupBy("h").agg(F.array_distinct(F.array(*each)).alias("p"))
    return chosen.select("h", F.explode("p").alias("p")).select("h", "p.*")


def _sketched(now: DataFrame, sets: DataFrame) -> DataFrame:
    """now with the sketch of each k, in WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words = [folded(np.frombuffer(x.as_py(), np.uint64), WORDS).view(np.int64) for x in b.column(1)]
            offsets = pa.array(np.arange(len(words) + 1) * WORDS, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(words)))], ["k", "sketch"])

    own = sets.select("k", "sketch").join(now.select("k").distinct(), "k", "left_semi")
    return now.join(own.mapInArrow(run, "k long, sketch array<long>"), "k")


def _completed(links: DataFrame, rows: DataFrame, sets: DataFrame, least: Fraction, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of sets, so that all pairs of sets that have the similarity, and those of links, are connected.

    Shingles that lead up to PAIRED sets give their pairs. Of those that lead more, each round compares PIVOTS sets of the largest
    component, chosen by hash, with those outside it, which links most of a group of near copies; then only sets that are still in
    different components are paired, if their sketches allow it. Each round goes on from the components of the one before, not from single links,
    and makes them anew only if it has found links: each making is many small stages, whose plans and tasks the driver holds.
    """
    postings = _postings(rows)
    many = postings.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    met = written(sorted_join(postings, many, "h").distinct())
    light, heavy = met.where(F.col("n") <= PAIRED), met.where(F.col("n") > PAIRED)
    stars = components(links.union(_verified(_met(light, light, least, "x.k < y.k"), sets, least, whole)))
    if heavy.isEmpty():
        return stars
    now = _grouped(heavy, stars)
    for k in range(ROUNDS):
        if now.isEmpty():
            return stars
        more = _verified(_met(now.where("minor"), _pivots(now, range(k * PIVOTS, (k + 1) * PIVOTS)), least, "x.k <> y.k"), sets, least, whole)
        if not more.isEmpty():
            stars = components(stars.union(more))
            discard(now)
            now = _grouped(heavy, stars)
    if now.isEmpty():
        return stars
    known = written(_sketched(now, sets))
    rest = _met(known.where("minor"), known, least, "x.component <> y.component and (not y.minor or x.k < y.k)")
    more = _verified(rest, sets, least, whole)
    discard(met, now, known)
    return stars if more.isEmpty() else components(stars.union(more))


def similar_groups(docs: DataFrame, width: int = 5, least: str = "0.8", tau: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text): the smallest doc_id reachable over links.

    Texts link where the Jaccard similarity of their `width`-word shingles is `least` (a decimal number
    above 0) or more; all such pairs are connected and no others are links. Fingerprints within tau bits (an even number) are compared
    first. Texts of one shingle set, or without words, are one. A null doc_id gets a component but never names one while it has
    another id; an empty table gives an empty result. docs is read for each comparison, and has to be the same each time.
    """
    part = Fraction(least)
    rows, whole = written(_sets(docs, width, part)), _from_texts(docs, width)
    same = [F.any_value(c).alias(c) for c in ("fp", "size", "sketch")]
    keys = written(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark"), *same))
    sets = keys.where("size > 0").withColumn("k", F.xxhash64("key"))
    groups = _completed(_verified(_by_fingerprint(sets, tau), sets, part, whole), rows, sets, part, whole)
    named = keys.select("key", "least").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = named.select("key", "component").join(ids, "component").select("key", "component_id")
    return rows.select("doc_id", "key", "fp").join(by_key, "key").select("doc_id", "fp", "component_id")
