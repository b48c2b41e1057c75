"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key, then scored by their worst cut.

Texts are cut into shards of word ids once. Each shard's suffix array is ordered in ranges of suffixes that start alike, one at a time, by
two words in one number, and the intervals of its longest-common-prefix array are the shard's
different n-grams with their counts, which are summed by (lang, phrase) over all shards. A phrase that occurs `least` times is made of
words and pairs that do, so words are counted first; then pairs of frequent words, by a 32-bit hash alone; and then all phrases
whose pairs are frequent. What is frequent is sent to shards as a bit map of hashes, of a size that is bounded. Where hashes
meet, a phrase is counted that need not be, and no count changes: the sums by (lang, phrase) decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import setting, shared, table, written

#: Bytes of text that a task gathers, over all languages, before it closes their shards; bytes of whole texts that are split at a time.
SHARD, CHUNK = 1 << 25, 1 << 20
#: Places of a range of a shard's suffix array, about; only a range is held in memory besides the shard.
RANGE = 1 << 18
#: Shards of so many bytes together make a row group or an Arrow batch, so that a task holds few at a time, however many its partition makes.
HELD = 1 << 23
GROUPS = {"parquet.block.size": HELD, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: A bit map has this many bits for each frequent phrase, and at least and at most so many (the most: 64 MB).
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
#: Parts of a language in which its phrases are ranked before all of it is.
PARTS = 64
#: A-Z become a-z, a tab a space, and what ends a piece a line feed.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def shards(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, n, words, ids): the texts of a task by language. `words` are a shard's different words and `ids` its texts as 32-bit
    places in them, -1 between pieces; n is its number of words.
    """

    class Shard:
        """One language's texts as places in a dictionary that grows with them."""

        def __init__(self):
            self.at: dict[bytes, int] = {b"": -2, b"\n": -1}
            self.ids: list[np.ndarray] = []
            self.texts: list[bytes] = []
            self.size = 0

        def add(self, text: bytes) -> None:
            self.texts.append(text)
            self.size += len(text)
            if self.size >= CHUNK:
                self.split()

        def split(self) -> None:
            data = (b"\n".join(self.texts) + b"\n").translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
            at = self.at
            ids = np.fromiter((at.setdefault(w, len(at) - 2) for w in data), np.int32, len(data))
            ids = ids[ids > -2]
            self.ids.append(ids[np.r_[True, (ids[1:] >= 0) | (ids[:-1] >= 0)][: len(ids)]])
            self.texts, self.size = [], 0

    def closed(kept: dict[str, Shard]) -> Iterator[pa.RecordBatch]:
        for name, shard in kept.items():
            shard.split()
            ids = np.concatenate(shard.ids)
            words = list(shard.at)[2:]
            columns = [pa.array([name]), pa.array([int((ids >= 0).sum())], pa.int64()), pa.array([words], pa.list_(pa.binary())), pa.array([ids.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "words", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Shard] = {}
        size = 0
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if name not in kept:
                    kept[name] = Shard()
                kept[name].add(raw)
                size += len(raw)
                if size >= SHARD:
                    yield from closed(kept)
                    kept, size = {}, 0
        yield from closed(kept)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, n long, words array<binary>, ids binary")


def _runs(ids: np.ndarray, least: int) -> np.ndarray:
    """ids without the pieces of fewer than `least` words."""
    ends = np.flatnonzero(np.r_[ids < 0, True])
    sizes = np.diff(np.r_[-1, ends])
    return ids[np.repeat(sizes > least, sizes)[: len(ids)]]


def _ranges(ids: np.ndarray, shared: int) -> Iterator[np.ndarray]:
    """Places of words, about RANGE at a time; suffixes that share their first word, or the first two if `shared` is 2 or more, are in one range."""
    n = min(-(-len(ids) // RANGE), (1 << 16) - 1)
    if n < 2:
        yield np.flatnonzero(ids >= 0)
        return
    of = np.empty(len(ids), np.uint16)
    for lo in range(0, len(ids), RANGE):
        own = ids[lo : lo + RANGE]
        h = own.astype(np.uint32) * np.uint32(0x9E3779B1)
        if shared > 1:
            ahead = ids[lo + 1 : lo + 1 + RANGE]
            h[: len(ahead)] += ahead.astype(np.uint32) * np.uint32(0x85EBCA77)
        of[lo : lo + RANGE] = np.where(own >= 0, (h ^ (h >> np.uint32(15))) % np.uint32(n), n)
    for k in range(n):
        yield np.flatnonzero(of == k)


def suffix_words(ids: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first, second, ... word from each of the places on, -1 from the end of its piece on."""
    out = [ids[at]]
    for j in range(1, depth):
        w = ids[np.minimum(at + j, len(ids) - 1)]
        w[(at + j >= len(ids)) | (out[-1] < 0)] = -1
        out.append(w)
    return out


def suffix_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of suffixes by these words; one that ends sooner comes before those that go on."""
    keys = [words[j].astype(np.int64) << 32 | (words[j + 1] + np.int32(1)) if j + 1 < len(words) else words[j] for j in range(0, len(words), 2)]
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


def intervals(ids: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, counts) for each k, again for each range: of each different k-gram, once, its first place in suffix order and how often it occurs, within pieces.

    `ids` are places of words from 0 up, -1 where a piece ends. Only one range of the suffix array is held at a time. Two neighbours in it share k words at least
    where none of their first k words differ, so runs of such neighbours are the intervals of that longest common prefix.
    """
    for at in _ranges(ids, shortest):
        words = suffix_words(ids, at, longest)
        order = suffix_order(words)
        new = np.zeros(len(at), bool)
        new[:1] = True
        for k, word in enumerate(words, 1):
            word = word[order]
            new[1:] |= word[1:] != word[:-1]
            own = np.flatnonzero(word >= 0)
            if k < shortest or not len(own):
                continue
            first = np.flatnonzero(new[own])
            yield k, at[order[own[first]]], np.diff(np.r_[first, len(own)])


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64 has them."""
    import xxhash

    lead = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh64_intdigest(lead + w, 42) for w in words), np.uint64, len(words))


def pair_hashes(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """32 bits from the hashes of two words, of which the places are given."""
    out = np.empty(len(first), np.uint32)
    for lo in range(0, len(out), 1 << 18):  # a few MB at a time
        out[lo : lo + (1 << 18)] = _paired(words[first[lo : lo + (1 << 18)]], words[second[lo : lo + (1 << 18)]])
    return out


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * np.uint64(0x9E3779B97F4A7C15) ^ (second >> np.uint64(29)) ^ second) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(32)


class Map:
    """A bit map of hashes."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.empty(len(hashes), bool)
        for lo in range(0, len(out), 1 << 18):
            at = hashes[lo : lo + (1 << 18)] & np.uint64(self.bits - 1)
            out[lo : lo + (1 << 18)] = self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
        return out


def bit_map(frequent: DataFrame, h: Column) -> Map:
    """The map of the hashes `h` of frequent's rows. Its 64-bit words are put together by Spark; at most MOST_BITS / 64 of them reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * frequent.count()).bit_length()))
    bit = F.expr("shiftleft(1L, cast(h & 63L as int))")
    each = frequent.select(h.bitwiseAND(F.lit(bits - 1).cast("long")).alias("h")).groupBy(F.shiftrightunsigned("h", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[each.column("word").to_numpy()] = each.column("bits").to_numpy().view(np.uint64)
    return Map(bits, words)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for b in batches:
        for name, words, raw in zip(*(b.column(k) for k in range(3))):
            yield name.as_py(), words.values, np.frombuffer(raw.as_buffer(), np.int32)


def word_counts(cut: DataFrame) -> DataFrame:
    """(lang, phrase, k, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in _opened(batches):
            for _, at, counts in intervals(ids, 1, 1):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), words.take(pa.array(ids[at])).cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "f"])

    found = cut.select("lang", "words", "ids").mapInArrow(run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.lit(1).alias("k"), F.sum("f").alias("f"))


def _frequent_words(lang: str, words: pa.Array, ids: np.ndarray, known: Map) -> tuple[np.ndarray, np.ndarray]:
    """ids cut at words that aren't frequent, and the words' hashes."""
    h = word_hashes(lang, words.to_pylist())
    ok = np.r_[known.holds(h), False]
    return np.where(ok[ids], ids, -1).astype(np.int32), h


def _cut_at_rare(ids: np.ndarray, h: np.ndarray, pairs: Map) -> np.ndarray:
    """ids with a cut between the two words of each pair that isn't frequent: each may go on the other way."""
    rare = np.zeros(len(ids), bool)
    for lo in range(0, len(ids), RANGE):
        own = ids[lo : lo + RANGE + 1]
        met = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
        rare[lo + met] = ~pairs.holds(pair_hashes(h, own[met], own[met + 1]))
    cuts = np.flatnonzero(rare)
    kept = np.ones(len(ids) + len(cuts), bool)
    kept[cuts + np.arange(1, len(cuts) + 1)] = False
    out = np.full(len(kept), -1, np.int32)
    out[kept] = ids
    return out


def pair_counts(cut: DataFrame, known: Map) -> DataFrame:
    """(h, f): how often the pairs of frequent words occur, by their 32-bit hash over all languages."""
    sent = shared(cut.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for lang, words, ids in _opened(batches):
            ids, h = _frequent_words(lang, words, ids, known)
            ids = _runs(ids, 2)
            for _, at, counts in intervals(ids, 2, 2):
                pair = pair_hashes(h, ids[at], ids[at + 1]).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts.astype(np.int64))], ["h", "f"])

    return cut.select("lang", "words", "ids").mapInArrow(run, "h int, f long").groupBy("h").agg(F.sum("f").alias("f"))


def phrase_counts(cut: DataFrame, longest: int, words: Map, pairs: Map) -> DataFrame:
    """(lang, phrase, k, f) of phrases of 2 to `longest` words whose words and pairs may all be frequent."""
    sent = shared(cut.sparkSession, (words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_pairs = sent()
        for lang, words, ids in _opened(batches):
            ids, h = _frequent_words(lang, words, ids, known)
            ids = _runs(_cut_at_rare(ids, h, known_pairs), 2)
            for k, at, counts in intervals(ids, 2, longest):
                for lo in range(0, len(at), 1 << 17):
                    some = at[lo : lo + (1 << 17)]
                    phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[some + j])) for j in range(k)], b" ").cast(pa.string())
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), phrase, pa.array(np.full(n, k, np.int32)), pa.array(counts[lo : lo + n].astype(np.int64))], ["lang", "phrase", "k", "f"])

    found = cut.select("lang", "words", "ids").mapInArrow(run, "lang string, phrase string, k int, f long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def frequent_phrases(cut: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, k, f) of phrases of 1 to `longest` words that occur `least` times or more in a language; `cut` is what `shards` gives, written."""
    often = F.col("f") >= least
    with setting(cut.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(HELD)):
        words = written(word_counts(cut).where(often))
        known = bit_map(words, F.xxhash64(F.concat("lang", F.lit("\n"), "phrase")))
        pairs = written(pair_counts(cut, known).where(often))
        return words.unionByName(written(phrase_counts(cut, longest, known, bit_map(pairs, F.col("h").cast("long"))).where(often)))


def _times(*columns: str | Column) -> Column:
    """An exact product."""
    out = F.lit(1).cast("decimal(38,0)")
    for c in columns:
        out = (out * (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, scale: int = 1000, inside: int = 100, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words: (lang, rank, phrase, a, l, r, n, score).

    a is how often a phrase occurs, n how many words its language has. Cutting it after k words leaves parts that occur l and
    r times and scores floor(scale * a * n / (l * r)); the cut that scores least counts, of equal ones the first. Phrases inside a
    longer one that occurs at least `inside` percent as often go. Ties in rank go by a, then by phrase in byte order. A null lang is
    `und`, a null text has no words; rows that repeat count each; other columns are not read. No rows for an empty table.
    """
    cut = written(shards(docs), **GROUPS)
    sizes = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    known = frequent_phrases(cut, longest, least)
    words = F.split("phrase", " ")
    joined = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    longer = known.where("k > 2").select("lang", "f", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))).alias("phrase"))
    # A phrase two words longer holds one that is one word longer and no rarer, so those decide.
    covered = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    kept = known.where("k > 1").join(covered, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (100 * F.col("_most") < inside * F.col("f"))).drop("_most")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    count = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(count("head", "l"), ["lang", "head"]).join(count("tail", "r"), ["lang", "tail"]).join(sizes, "lang")
    cuts = cuts.withColumns({"_up": _times(F.lit(scale), "a", "n"), "_down": _times("l", "r")}).withColumn("score", F.expr("_up div _down"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("s")).select("lang", "phrase", "s.*")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("_part")
    some = worst.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("rank") <= top).drop("rank", "_part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
  SELECT row_number() OVER () id, lang, piece FROM (
    SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece FROM documents)),
lists AS (SELECT id, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') w FROM pieces),
n AS (SELECT lang, sum(len(w))::HUGEINT n FROM lists GROUP BY 1),
grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM lists, (SELECT unnest(range(1, 6)) k))),
f AS (SELECT lang, k, g, count(*) a FROM grams GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT lang, unnest([list_slice(g, i, i + j - 1) FOR i IN range(1, k - j + 2)]) g, a FROM (SELECT *, unnest(range(2, k)) j FROM f WHERE k > 2)),
most AS (SELECT lang, g, max(a) a FROM longer GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN most USING (lang, g) WHERE k > 1 AND (most.a IS NULL OR 100 * most.a < 100 * f.a)),
cuts AS (SELECT *, unnest(range(1, k)) c FROM kept),
scored AS (
  SELECT cuts.lang, cuts.g, c, cuts.a, x.a l, y.a r, n, (1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = list_slice(cuts.g, 1, c) JOIN f y ON y.lang = cuts.lang AND y.g = list_slice(cuts.g, c + 1, cuts.k) JOIN n ON n.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n::BIGINT n, score::BIGINT score FROM ranked WHERE rank <= 2000
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
