"""Benchmark decontamination: rare words as seeds of an equi-join, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, shared, sorted_join, table, written

#: Distinct words of all test items up to which they are sent to every task, to drop other words at once (32 MB); beyond that, a join drops them.
VOCABULARY = 4_000_000
#: Items' words over all pairs up to which pairs are broadcast to fetch their texts (32 MB); beyond that, texts are shuffled.
PAIR_WORDS = 4_000_000
#: Characters of text that are hashed together, and words whose hashes a task keeps.
PART, KEPT = 1 << 22, 1 << 20
_WORD = re.compile(r"\w+")
#: Smith-Waterman: a matched word, and a changed, missing or added one.
MATCH, EDIT = 4, -1


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Hashes(dict):
    """word -> its 64-bit hash, kept for up to KEPT words."""

    def __missing__(self, w: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words(text)), np.uint64)


def aligned(item: np.ndarray, passage: np.ndarray) -> float:
    """Share of the item's words that its best local alignment in the passage matches.

    The alignment maximises MATCH for each matched word and EDIT for each other step, then matches. One row for
    each word of the item; gaps along the passage are a running maximum.
    """
    unit = 1 << 20
    best, top = np.zeros(len(passage) + 1, np.int64), 0
    slope = np.arange(len(passage) + 1) * (-EDIT * unit)
    for w in item.tolist():
        step = np.where(passage == w, MATCH * unit + 1, EDIT * unit)
        row = np.maximum(best + EDIT * unit, 0)
        row[1:] = np.maximum(row[1:], best[:-1] + step)
        row = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
        top = max(top, int(row.max()))
        best = row
    return (top & (unit - 1)) / max(1, len(item))


def passages(item: np.ndarray, doc: np.ndarray, need: int) -> Iterator[np.ndarray]:
    """Pieces of the document that hold every alignment with the item that matches `need` words.

    An alignment of positive score has fewer than MATCH steps that don't match for each that does, so
    it spans at most `reach` words. Stretches of the item's length are kept if enough of its words are near.
    """
    m = len(item)
    reach, known = (1 + MATCH) * m, np.cumsum(np.r_[0, np.isin(doc, item)])
    lo = np.maximum(np.arange(0, len(doc), m) - reach, 0)
    hi = np.minimum(np.arange(0, len(doc), m) + m + reach, len(doc))
    some = known[hi] - known[lo] >= need
    lo, hi = lo[some], hi[some]
    if not len(lo):
        return
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    for a, b in zip(lo[new].tolist(), hi[np.r_[new[1:] - 1, len(hi) - 1]].tolist()):
        for at in range(a, b, 1 << 16):  # long runs in overlapping pieces
            yield doc[at : min(b, at + (1 << 16) + reach)]


def _items(benchmark: DataFrame, least: float) -> DataFrame:
    """(item, item_id, times, words, need): each distinct test item of a word or more, its words as hashes, and how many a match needs."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    some = benchmark.where("item_id is not null and text is not null").groupBy("item_id", "text").agg(F.count("*").alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            found = [hashes.of(t.as_py()) for t in b.column(2)]
            need = [next((k for k in range(1, len(h) + 1) if k / len(h) >= least), 0) for h in found]
            keep = pa.array([n > 0 for n in need])
            columns = [*b.columns[:2], b.column(3), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), pa.array(need, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["item", "item_id", "times", "words", "need"])

    keyed = some.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text", "times")
    return keyed.mapInArrow(run, f"item long, item_id {kind}, times long, words array<long>, need int")


def _document_words(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(rk, h, n): how often a row of docs has each word of the items; rk is the row's key."""
    spark = docs.sparkSession
    few = vocabulary.limit(VOCABULARY + 1).count() <= VOCABULARY
    sent = shared(spark, np.sort(vocabulary.toArrow().column(0).to_numpy().view(np.uint64)) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = sent(), Hashes()
        for b in batches:
            held, many = [], 0
            for i, t in enumerate(b.column(1)):
                held.append((i, hashes.of(t.as_py())))
                many += len(held[-1][1])
                if many >= PART // 4:
                    yield counted(b.column(0), held, known)
                    held, many = [], 0
            yield counted(b.column(0), held, known)

    def counted(keys: pa.Array, held: list, known: np.ndarray | None) -> pa.RecordBatch:
        row = np.repeat([i for i, _ in held], [len(h) for _, h in held]).astype(np.int64)
        h = np.concatenate([h for _, h in held] or [np.zeros(0, np.uint64)])
        if known is not None:
            own = known[np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))] == h if len(known) else np.zeros(len(h), bool)
            row, h = row[own], h[own]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(h)])
        n = np.diff(np.r_[at, len(h)])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row[at])), pa.array(h[at].view(np.int64)), pa.array(n, pa.int32())], ["rk", "h", "n"])

    found = docs.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("rk"), "text").mapInArrow(run, "rk long, h long, n int")
    return found if few else sorted_join(found, vocabulary, "h", "left_semi").select("rk", "h", "n")


def _seeds(items: DataFrame, held: DataFrame) -> DataFrame:
    """(item, h, many, req): the rarest words of each item; a document that matches has them `req` times in all, each at most `many` times.

    An item of m words needs `need` matched places, so of any m - need + s places s at least are matched. Words are taken
    rarest first, by the number of document rows that have them, until they make up as many places, with s a quarter of m.
    """
    m = F.size("words")
    places = (m - F.col("need") + F.least(F.col("need"), F.ceil(m / 4).cast("int"))).alias("places")
    each = items.select("item", (m - F.col("need")).alias("spare"), places, F.explode("words").alias("h"))
    each = each.groupBy("item", "spare", "places", "h").agg(F.count("*").alias("many"))
    df = held.groupBy("h").agg(F.count("*").alias("df"))
    before = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.join(df, "h", "left").withColumn("sum", F.coalesce(F.sum("many").over(before), F.lit(0)))
    taken = ranked.where("sum < places")
    return taken.select("item", "h", "many", (F.sum("many").over(Window.partitionBy("item")) - F.col("spare")).alias("req"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity): documents whose best alignment matches at least `least` of an item's words.

    Words of documents and items are joined by hash: an item's rarest words over all documents seed it, as many as
    a match at `least` can't do without (see _seeds), and pairs with enough of them are aligned, so no match is
    lost at any size of the input. Null or wordless texts and items, and items of a null item_id, match nothing. Each row of
    docs gives its own rows, repeated rows equal ones; items that repeat each give theirs. Ids keep their types; other columns
    are not carried. Empty tables give no rows.
    """
    items = written(_items(benchmark, least))
    vocabulary = items.select(F.explode("words").alias("h")).distinct()
    held = written(_document_words(docs, vocabulary))
    met = sorted_join(held, _seeds(items, held), "h").groupBy("rk", "item", "req").agg(F.sum(F.least("n", "many")).alias("got"))
    pairs = written(met.where("got >= req").select("rk", "item"))
    discard(held)
    tests = F.collect_list(F.struct("item_id", "times", "need", "words")).alias("tests")
    by_row = pairs.join(items, "item").groupBy("rk").agg(tests)
    if (pairs.join(items, "item").agg(F.sum(F.size("words") + 4)).first()[0] or 0) <= PAIR_WORDS:
        by_row = F.broadcast(by_row)
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk")).join(by_row, "rk").select("doc_id", "text", "tests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            rows = []
            for doc_id, text, found in zip(*(b.column(k) for k in range(3))):
                doc = hashes.of(text.as_py())
                for test in found.values:
                    item = test["words"].values.to_numpy().view(np.uint64)
                    best = max((aligned(item, p) for p in passages(item, doc, test["need"].as_py())), default=0.0)
                    if best >= least:
                        rows += [(doc_id.as_py(), test["item_id"].as_py(), best)] * test["times"].as_py()
            kinds = (b.schema.field(0).type, b.schema.field(2).type.value_type.field("item_id").type, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "similarity"])

    kinds = [x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    return texts.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double")


def op3(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
