"""Token counts of whole texts under a public subword tokenizer, without a shuffle of pre-tokens.

A merge of this kind of tokenizer never reaches over a white space, so a text's count is the sum of its pre-tokens'. Those
are looked up in two tiers, both inside the task that reads the text:
  1. A hash table of frequent pre-tokens' lengths, made once and broadcast. Every task sums up its own pre-tokens in a
     bounded summary (`frequent`), and summaries are merged in a tree; the table steers cost and never a count.
  2. A cache in each worker process. What neither holds is encoded by the tokenizer's own library, each batch's misses at once.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, table

#: Entries of the broadcast table, of a task's summary while it counts, and of a worker's cache.
FREQUENT, SUMMARY, CACHED = 1 << 16, 1 << 17, 1 << 19
#: Pre-tokens of more characters are encoded each time: neither tier holds long ones, so both are bounded in bytes.
LONGEST = 48
#: Texts that a worker has in pre-tokens at a time, and summaries that one task merges.
ROWS, MERGED = 128, 200
SPACE, MARK = " ", "▁"


class Pieces:
    """A sentencepiece model as lengths of pre-tokens.

    White space is a space or its mark, and every text is led by one. A pre-token is a run of them and what follows up
    to the next; it goes by its text less the first space. That a piece never goes on after a white space is checked on
    the vocabulary, as is that the model leaves texts as they are.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size()) if not self.model.is_control(k)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model goes on after a white space, so pre-tokens can't be counted apart")
        for text in ("a  b ", " Ａﬁ\t½  "):
            if self.model.decode(self.model.encode(text)) != text:
                raise ValueError("this model rewrites texts, so pre-tokens can't be cut from them")
        #: A space that nothing follows has the empty name, for which the library gives no tokens.
        self.last = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, SPACE)
        if "  " not in text and text[0] != SPACE:
            return text.split(SPACE)
        return [x[1:] for x in re.findall(" +[^ ]*", SPACE + text)]

    def lengths(self, names: list[str]) -> list[int]:
        return [len(x) if name else self.last for name, x in zip(names, self.model.encode(names, num_threads=1))]


def _loaded(sent) -> tuple[Pieces, dict[str, int], dict[str, int]]:
    """(tokenizer, frequent lengths, both tiers in one) of this worker process, which outlive a task where workers are used again.

    Functions travel by value, with globals of their own in each task, so what is to stay hangs on a module of the process.
    """
    model, names, lengths = sent()
    key = hashlib.sha256(b"%d %d " % (len(model), len(lengths)) + model + names.encode() + lengths).digest()
    held = sys.modules.setdefault("_tidegauge_worker", types.ModuleType("_tidegauge_worker")).__dict__
    if held.get("key") != key:
        known = dict(zip(names.split(SPACE), memoryview(lengths).cast("H"))) if lengths else {}
        held.update(key=key, tiers=(Pieces(model), known, dict(known)))
    return held["tiers"]


def _texts(column: pa.Array) -> Iterator[str]:
    return ((x.as_py() or "") for x in column)


def frequent(docs: DataFrame, model: bytes, entries: int = FREQUENT) -> list[str]:
    """Pre-tokens that are frequent over all texts, at most `entries`, none with a space inside.

    Each task counts its own, and whenever it holds over SUMMARY of them drops the rarer half (those it drops were rare where they
    stood). Its summary leaves as one row, and rows are merged MERGED at a time until one is left: what moves is bounded by
    the number of tasks and not by that of pre-tokens.
    """

    schema = "part long, names string, counts array<long>"

    def packed(part: int, counts: Counter) -> pa.RecordBatch:
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:entries]
        columns = [pa.array([part], pa.int64()), pa.array([SPACE.join(w for w, _ in top)]), pa.array([[n for _, n in top]], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "names", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = Pieces(model), Counter()
        for b in batches:
            for text in _texts(b.column(0)):
                counts.update(pieces.split(text))
                if len(counts) > SUMMARY:
                    counts = Counter(dict(counts.most_common(SUMMARY // 2)))
        counts = {w: n for w, n in counts.items() if n > 1 and 0 < len(w) <= LONGEST and SPACE not in w}
        yield packed(TaskContext.get().partitionId(), counts)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        counts = Counter()
        for names, ns in zip(t.column("names"), t.column("counts")):
            if len(ns):
                counts.update(dict(zip(names.as_py().split(SPACE), ns.values.to_pylist())))
        return pa.Table.from_batches([packed(key[0].as_py(), counts)])

    parts, many = docs.select("text").mapInArrow(count, schema), docs.rdd.getNumPartitions()
    while many > 1:
        many = -(-many // MERGED)
        parts = parts.groupBy(F.floor(F.col("part") / MERGED).alias("_part")).applyInArrow(merge, schema)
    found = parts.collect()
    return found[0].names.split(SPACE) if found and found[0].names else []


def token_counts(docs: DataFrame, model: str, limit: int = 4096, entries: int = FREQUENT) -> DataFrame:
    """docs without text, and with n_bytes, n_tokens and over_limit (more than `limit` tokens), in place of columns of those names.

    `model` is the path of a sentencepiece model, read once by the driver. Counts are those of the library for a whole text, without
    begin, end or added special tokens; special strings in a text are ordinary. A null text counts as empty: no bytes, no
    tokens. Rows that repeat are counted each; an empty table stays empty. All other columns are kept, whatever their names.
    """
    with open(model, "rb") as f:
        proto = f.read()
    names = frequent(docs, proto, entries)
    known = [(w, n) for w, n in zip(names, Pieces(proto).lengths(names)) if n < 1 << 16]
    lengths = b"".join(n.to_bytes(2, "little") for _, n in known)
    sent = shared(docs.sparkSession, (proto, SPACE.join(w for w, _ in known), lengths))
    return _counted(docs, sent, limit)


def _counted(docs: DataFrame, sent, limit: int) -> DataFrame:
    kept = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(0).alias("none")).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = rows.select("row", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, both = _loaded(sent)
        for b in batches:
            tokens = []
            for at in range(0, b.num_rows, ROWS):
                split = [pieces.split(text) for text in _texts(b.column(1).slice(at, ROWS))]
                if len(both) > len(known) + CACHED:
                    both.clear()
                    both.update(known)
                new = list(set().union(*split).difference(both))
                both.update(zip(new, pieces.lengths(new)))
                tokens += [sum(map(both.__getitem__, words)) for words in split]
                for name in new:
                    if len(name) > LONGEST:
                        del both[name]
            n_bytes = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), n_bytes], ["row", "n_tokens", "n_bytes"])

    counted = rows.mapInArrow(run, schema)
    return counted.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
