"""Exact substring dedup by longest-previous-factor arrays, cut at a threshold, over partitioned suffixes.

A byte goes if a `length`-byte string that covers it also starts in a document of smaller
doc_id: that is, if the longest previous factor at that string's start reaches `length`. In suffix order,
suffixes that share their first `length` bytes stand together, tied by longest common prefixes of `length` or more; the
previous or the next smaller document of a suffix inside such a run is an earlier match, and if there is neither, its
longest previous factor is shorter. So the first copy keeps its bytes.

Suffixes are cut down and dealt out before they are sorted. Every window of `length` bytes has an anchor, its
smallest `gram`-byte hash (leftmost if tied); equal windows have equal anchors at equal offsets.
  1. Anchor hashes are counted over all documents; those met once cannot repeat.
  2. Repeated anchors are joined back to their documents, as packed positions.
  3. Each such anchor's context (the windows that have it as their anchor) is cut from the text;
     equal contexts collapse to their smallest document before the shuffle, then each bucket of anchors
     puts its suffixes in order: those from the anchors on by their bytes, and those that start one byte further to the left
     by that byte and the order before, which a stable sort of one byte gives. Anchors with very many different
     contexts are dealt out by window in place of by anchor.
  4. What repeats goes back to its document as positions, and its bytes are removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, sorted_join, table, written

GRAM = 16
#: Window starts of a slice; their number must fit in the low 20 bits of a key.
SLICE = 1 << 20
#: Contexts in a bucket, and different contexts of one anchor beyond which it is dealt out by window.
IN_BUCKET, HOT = 25_000, 50_000
#: Parts that the copies of one text are dealt into.
SALTS = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes (a power of two) at each position."""
    h, base, n = data.astype(np.uint64) + np.uint64(1), int(_M1), 1
    while n < gram:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % (1 << 64), n * 2
    return _mixed(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x, n = np.minimum(x[:-n], x[n:]), n * 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM):
    """(hash, position, first window start, last window start) of each anchor in up to SLICE bytes of whole texts that end at `ends`."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = rolling(data, gram)
    low = np.uint64((1 << 21) - 1)
    key = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    starts = np.arange(len(key))
    left = np.repeat(ends, np.diff(ends, prepend=0))[: len(key)] - starts
    starts = starts[left >= length]
    at = (key[starts] & low).astype(np.int64)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
    return h[at[new]], at[new], starts[new], starts[np.r_[new[1:], len(at)] - 1]


def _slices(text: pa.Array, length: int):
    """(rows, data, ends, base): texts in slices of about SLICE bytes; a longer text in overlapping parts, its part starting at base."""
    text = pc.fill_null(text, "") if text.null_count else text
    if not len(text):
        return
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    off = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(text):
        if off[i + 1] - off[i] > SLICE:
            size = off[i + 1] - off[i]
            for base in range(0, size, SLICE):
                part = data[off[i] + base : off[i] + min(size, base + SLICE + length - 1)]
                yield np.array([i]), part, np.array([len(part)]), base
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        yield np.arange(i, j), data[off[i] : off[j]], off[i + 1 : j + 1] - off[i], 0
        i = j


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _of(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text that each position is in, and where that text starts."""
    d = np.searchsorted(ends, at, "right")
    return d, np.r_[0, ends][d]


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(h, n): in how many documents an anchor hash is met; pre-aggregated in each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, ends, _ in _slices(b.column(0), length):
                h, at, _, _ = anchors(data, ends, length)
                d, _ = _of(ends, at)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                one = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
                h, n = np.unique(h[one], return_counts=True)
                yield _batch({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def anchor_positions(docs: DataFrame, length: int) -> DataFrame:
    """(h, rk, pk): each anchor with its document's key and its position and offsets, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk = b.column(1).to_numpy()
            for rows, data, ends, base in _slices(b.column(0), length):
                h, at, lo, hi = anchors(data, ends, length)
                d, start = _of(ends, at)
                pk = ((at - start + base) << 12) | ((at - hi) << 6) | (at - lo)
                yield _batch({"h": h.view(np.int64), "rk": rk[rows[d]], "pk": pk})

    return docs.select("text", "rk").mapInArrow(run, "h long, rk long, pk long")


def contexts(found: DataFrame, length: int) -> DataFrame:
    """From (text, doc_id, rk, pks): one row for each anchor with its context's bytes; the anchor is `hi` bytes into them."""
    kinds = {"doc_id": pa.int64(), "rk": pa.int64(), "start": pa.int64(), "lo": pa.int8(), "hi": pa.int8(), "ctx": pa.binary()}

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * len(kinds), kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, doc, rk, pks in zip(*(b.column(i) for i in range(4))):
                raw, doc, rk = (text.as_py() or "").encode("utf-8", "surrogatepass"), doc.as_py(), rk.as_py()
                for pk in np.sort(pks.values.to_numpy()).tolist():
                    at, lo, hi = pk >> 12, (pk >> 6) & 63, pk & 63
                    if at >= hi and at - lo + length <= len(raw):
                        out.append((doc, rk, at - hi, lo, hi, raw[at - hi : at - lo + length]))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    return found.select("text", "doc_id", "rk", "pks").mapInArrow(run, "doc_id long, rk long, start long, lo byte, hi byte, ctx binary")


def by_bytes(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])


def earlier(rank: np.ndarray, tied: np.ndarray, far: int) -> np.ndarray:
    """Of suffixes in order, given their documents' ranks (below far) and whether each is tied to the one before: whether its longest previous factor reaches the tie's length.

    It does if a smaller document stands before it or after it in its run of ties: the previous and next smaller
    values are running minima, which start anew in each run because runs are set apart by more than any document.
    """
    run = np.cumsum(~tied)
    down, up = rank - run * far, rank + run * far
    before = np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(down)[:-1]]
    after = np.r_[np.minimum.accumulate(up[::-1])[::-1][1:], np.iinfo(np.int64).max]
    return (before < down) | (after < up)


def repeated_offsets(first: np.ndarray, lo: np.ndarray, hi: np.ndarray, ctx: list[bytes], length: int) -> np.ndarray:
    """A bit mask for each context: of which offsets o the window also starts in a document smaller than `first`.

    The window at offset o starts o bytes before the anchor. Suffixes are ordered from offset 0 up, each offset's from the one's before.
    """
    left, blank = length - GRAM, bytes(length)
    width = left + length
    rows = b"".join([blank[: left - h] + c + blank[: length + h - len(c)] for h, c in zip(hi.tolist(), ctx)])
    text = np.frombuffer(rows, np.uint8).reshape(-1, width)
    mask, rank = np.zeros(len(text), np.int64), np.unique(first, return_inverse=True)[1].astype(np.int64)
    order = by_bytes(text[:, left:])
    for o in range(left + 1):
        if o:
            order = order[hi[order] >= o]
            order = order[np.argsort(text[order, left - o], kind="stable")]
        own = order[lo[order] <= o]
        if len(own) < 2:
            continue
        window = np.ascontiguousarray(text[own, left - o : left - o + length]).view(f"V{length}").ravel()
        tied = np.r_[False, window[1:] == window[:-1]]
        mask[own[earlier(rank[own], tied, len(text))]] |= np.int64(1) << np.int64(o)
    return mask


def _keys() -> list:
    """A context's own 128-bit hash."""
    return [F.xxhash64("ctx", "lo", "hi").alias("c1"), F.xxhash64("hi", "lo", "ctx").alias("c2")]


def _anchor():
    return F.xxhash64(F.substr("ctx", F.col("hi") + 1, F.lit(GRAM)))


def _bucketed(distinct: DataFrame, buckets: int, length: int) -> DataFrame:
    """(c1, c2, first, mask) of contexts (first, n, lo, hi, ctx) that another document shares in whole or in part."""

    def run(t: pa.Table) -> pa.Table:
        get = lambda k: t.column(k).to_numpy()
        mask = repeated_offsets(get("first"), get("lo").astype(np.int64), get("hi").astype(np.int64), t.column("ctx").to_pylist(), length)
        keep = pa.array((mask != 0) | (get("n") > 1))
        return t.select(["ctx", "lo", "hi", "first"]).append_column("mask", pa.array(mask)).filter(keep)

    dealt = distinct.withColumn("bucket", F.pmod(_anchor(), F.lit(buckets)))
    met = dealt.groupBy("bucket").applyInArrow(run, "ctx binary, lo byte, hi byte, first long, mask long")
    return met.select(*_keys(), "first", "mask")


def _by_window(hot: DataFrame, length: int) -> DataFrame:
    """As _bucketed, for anchors of very many contexts: each window is a row, grouped by its own bytes."""
    at = F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int")))
    rows = hot.select(*_keys(), "first", "n", "hi", "ctx", at.alias("o"))
    rows = rows.select("c1", "c2", "first", "n", "o", F.md5(F.substr("ctx", F.col("hi") - F.col("o") + 1, F.lit(length))).alias("w"))
    least = rows.groupBy("o", "w").agg(F.min("first").alias("least"))
    bit = F.when(F.col("least") < F.col("first"), F.expr("shiftleft(1L, o)")).otherwise(F.lit(0).cast("long"))
    masks = sorted_join(rows, least, ["o", "w"]).groupBy("c1", "c2", "first").agg(F.bit_or(bit).alias("mask"), F.max("n").alias("n"))
    return masks.where("mask <> 0 or n > 1").drop("n")


def copies(keyed: DataFrame, length: int) -> DataFrame:
    """(doc_id, rk) of documents that are whole copies of a document of smaller doc_id; the copies of one text are joined in SALTS parts."""
    salt = F.pmod(F.xxhash64("rk"), F.lit(SALTS)).cast("int")
    texts = keyed.where(F.octet_length("text") >= length).select("doc_id", "rk", F.md5("text").alias("digest"), salt.alias("salt"))
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    parts = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return sorted_join(texts, parts, ["digest", "salt"]).where("doc_id > first").select("doc_id", "rk").distinct()


def _placed(kept: DataFrame, whole: DataFrame, length: int) -> tuple[DataFrame, int]:
    """(rk, pks) of repeated anchors outside whole copies, and how many documents' anchors are repeated."""
    counts = written(anchor_counts(kept, length).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    positions = anchor_positions(kept, length).join(counts.select("h"), "h", "left_semi")
    placed = written(positions.groupBy("rk").agg(F.collect_list("pk").alias("pks")).join(whole.select("rk"), "rk", "left_anti"))
    discard(counts)
    return placed, total


def _distinct(met: DataFrame) -> DataFrame:
    """Contexts once each: first is their smallest document, n 2 if there are others."""
    several = (F.max("doc_id") > F.min("doc_id")).cast("int") + 1
    return met.groupBy("ctx", "lo", "hi").agg(F.min("doc_id").alias("first"), several.alias("n"))


def _shared(distinct: DataFrame, buckets: int, length: int) -> DataFrame:
    """(c1, c2, first, mask) of all contexts that are shared."""
    anchored = distinct.withColumn("h", _anchor())
    hot = written(anchored.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select("h"))
    rest, many = anchored.join(hot, "h", "left_anti").drop("h"), anchored.join(hot, "h", "left_semi").drop("h")
    return written(_bucketed(rest, buckets, length).union(_by_window(many, length)))


def _hits(met: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, rk, hits): bit j of a hit's offsets is the window that starts at start + last - j."""
    hits = met.select("doc_id", "rk", "start", "lo", "hi", *_keys())
    every, own = F.expr("shiftleft(1L, hi - lo + 1) - 1L"), F.expr("shiftright(mask, lo)")
    offsets = F.when(F.col("doc_id") > F.col("first"), every).otherwise(own)
    last = (F.col("hi") - F.col("lo")).cast("long").alias("last")
    hits = sorted_join(hits, shared, ["c1", "c2"]).select("doc_id", "rk", F.struct("start", last, offsets.alias("offsets")).alias("hit"))
    return hits.where("hit.offsets <> 0").groupBy("doc_id", "rk").agg(F.collect_list("hit").alias("hits"))


def repeated_windows(keyed: DataFrame, length: int) -> DataFrame:
    """(doc_id, rk, hits): for documents (doc_id, text, rk), the window starts that repeat an earlier document; of whole copies a hit with last -1."""
    kept = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    whole = written(copies(kept, length))
    placed, total = _placed(kept, whole, length)
    met = written(contexts(kept.join(placed, "rk"), length))
    discard(placed)
    distinct = written(_distinct(met))
    shared = _shared(distinct, max(1, math.ceil(total / IN_BUCKET)), length)
    discard(distinct)
    zero = F.lit(0).cast("long")
    all_of = F.array(F.struct(zero.alias("start"), F.lit(-1).cast("long").alias("last"), zero.alias("offsets")))
    hits = written(_hits(met, shared).union(whole.select("doc_id", "rk", all_of)))
    discard(met, shared, whole)
    return hits


def removed_bytes(size: int, start: np.ndarray, last: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """True for each byte covered by a repeated window, for hits of these starts, lasts and offsets."""
    if (last < 0).any():
        return np.ones(size, bool)
    step = np.zeros(size + 1, np.int32)
    for j in range(int(last.max(initial=-1)) + 1):
        at = (start + last - j)[(last >= j) & (offsets >> j & 1 > 0)]
        np.add.at(step, at, 1)
        np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def to_characters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """off, widened over UTF-8 bytes `data` to whole characters, so that what is left is UTF-8 again."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.logical_or.reduceat(off, starts), np.diff(np.r_[starts, len(data)])) if len(data) else off


def dedup_substrings(docs: DataFrame, length: int = 50, characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 in place of columns of those names.

    Texts are UTF-8 bytes, null as empty. A byte is removed if a `length`-byte string of the input
    that covers it also starts in a document of smaller doc_id; the earliest copy stays whole.
    Rows of a null doc_id neither lose bytes nor take them; rows that repeat a doc_id don't affect
    each other. Texts under `length` bytes stay. An empty table stays empty. doc_id is an integer;
    length is 17 to 50. With `characters`, a character goes with any of its bytes, so kept stays UTF-8.
    """
    if not GRAM < length <= 50:
        raise ValueError("length must be 17 to 50")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "_id", "_rk", "_hits")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("rk"))
    found = repeated_windows(keyed, length).select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), F.col("hits").alias("_hits"))
    joined = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_rk": key}).join(found, ["_id", "_rk"], "left").drop("_id", "_rk")
    names = [c for c in joined.columns if c != "_hits"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            hits = b.column(b.schema.get_field_index("_hits"))
            for text, found in zip(b.column(b.schema.get_field_index("text")), hits):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, gone, spans = raw, 0, 0
                if found.is_valid:
                    rows = found.values
                    data = np.frombuffer(raw, np.uint8)
                    off = removed_bytes(len(raw), *(rows.field(k).to_numpy(zero_copy_only=False) for k in ("start", "last", "offsets")), length)
                    off = to_characters(data, off) if characters else off
                    gone, spans = int(off.sum()), int(np.count_nonzero(np.diff(off.astype(np.int8), prepend=0) == 1))
                    kept = data[~off].tobytes()
                for k, v in zip(new, (len(raw), gone, spans, kept, hashlib.sha256(kept).hexdigest())):
                    new[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            arrays = [b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(v, t) for v, t in zip(new.values(), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *new])

    return joined.select(*names, "_hits").mapInArrow(
        run, schema + ", n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )


def op9(spark, sf_dir):
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
