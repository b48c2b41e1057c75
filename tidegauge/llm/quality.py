"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared, table
from .langid import crc_fold, least_hashes

#: Features: hashed words, then structure and metadata bins.
WORDS, BINS, FACTORS = 1 << 14, 1 << 10, 8
#: Labelled rows that are fitted, about; those of least hash.
TRAIN_ROWS = 8_000
_SYMBOL = re.compile(r"[^\w\s.,;:'’\"()!?-]")


def _bin(name: str, value) -> int:
    return WORDS + zlib.crc32(f"{name}={value}".encode()) % BINS


def structure(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(text))
    return {
        "symbols": len(_SYMBOL.findall(text)) / n,
        "marks": (text.count("!") + text.count("?")) / n,
        "digits": len(re.findall(r"\d", text)) / n,
        "upper": len(re.findall(r"[A-Z]", text)) / n,
        "spaces": (len(text) - sum(map(len, words))) / n,
        "variety": len(counts) / max(1, len(words)),
        "top": max(counts.values(), default=0) / max(1, len(words)),
        "word": sum(map(len, words)) / max(1, len(words)) / 20,
        "lines": len(set(lines)) / max(1, len(lines)),
        "line": math.log2(1 + n / max(1, len(lines))) / 20,
        "length": math.log2(1 + len(words)) / 20,
    }


def features(text: str | None, metadata: dict | None = None) -> tuple[list[int], list[float]]:
    """Feature numbers and values: words by log count scaled to unit length, a one for each statistic's bin and each metadata value."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    hashed: dict[int, float] = {}
    for w, c in counts.items():
        k = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
        hashed[k] = hashed.get(k, 0.0) + math.log1p(c)
    norm = math.sqrt(sum(v * v for v in hashed.values())) or 1.0
    ids, values = list(hashed), [v / norm for v in hashed.values()]
    for name, v in structure(text, words, counts).items():
        ids.append(_bin(name, round(8 * math.sqrt(min(max(v, 0.0), 4.0)), 0)))
        values.append(1.0)
        ids.append(_bin(name + "+", v > 0.02))
        values.append(1.0)
    for name, v in (metadata or {}).items():
        ids.append(_bin(name, None if v is None else int(math.log2(1 + abs(v))) if isinstance(v, (int, float)) else v))
        values.append(1.0)
    return ids, values


class FactorisationMachine:
    """w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the pairs as half of (sum v x)^2 - sum (v x)^2: linear in a row's features."""

    def __init__(self, size: int = WORDS + BINS, factors: int = FACTORS, seed: int = 5):
        self.b, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (size, factors))

    def _forward(self, ids, x, starts):
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (s**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return self.b + np.add.reduceat(self.w[ids] * x, starts) + pairs, vx, s

    def score(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        size = [len(r[0]) for r in rows]
        ids = np.fromiter((i for r in rows for i in r[0]), np.int64, sum(size))
        x = np.fromiter((v for r in rows for v in r[1]), float, sum(size))
        raw, _, _ = self._forward(ids, x, np.cumsum([0, *size[:-1]]))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 5):
        """Adam on the log loss, over the rows in random order."""
        draw = np.random.default_rng(seed)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.b = math.log(p / (1 - p))
        mom = [[np.zeros_like(a), np.zeros_like(a)] for a in (self.w, self.v)]
        t = 0
        for _ in range(epochs):
            order = draw.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                size = np.array([len(rows[i][0]) for i in part])
                ids = np.concatenate([rows[i][0] for i in part]).astype(np.int64)
                x = np.concatenate([rows[i][1] for i in part]).astype(float)
                raw, vx, s = self._forward(ids, x, np.r_[0, np.cumsum(size)[:-1]])
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                each = np.repeat(g, size) * x
                grads = (
                    np.bincount(ids, each, len(self.w)) + decay * self.w,
                    np.stack([np.bincount(ids, d, len(self.w)) for d in (each[:, None] * (np.repeat(s, size, axis=0) - vx)).T], axis=1) + decay * self.v,
                )
                t += 1
                self.b -= rate * g.sum()
                for a, d, m in zip((self.w, self.v), grads, mom):
                    m[0] = 0.9 * m[0] + 0.1 * d
                    m[1] = 0.999 * m[1] + 0.001 * d * d
                    a -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
        return self


def _rows(b: pa.RecordBatch, metadata: tuple[str, ...]):
    other = [b.column(b.schema.get_field_index(m)).to_pylist() for m in metadata]
    for i, t in enumerate(b.column(b.schema.get_field_index("text"))):
        yield features(t.as_py(), {m: v[i] for m, v in zip(metadata, other)})


def train(labelled: DataFrame, label: str, metadata: tuple[str, ...], rows: int = TRAIN_ROWS) -> FactorisationMachine | None:
    """Fitted on about `rows` rows of labelled (text, label, metadata and any other columns), those of least hash; None without a labelled row."""
    sample = least_hashes(labelled.where(F.col(label).isNotNull()), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_rows(b, metadata))
            y = b.column(b.schema.get_field_index(label)).cast(pa.float64())
            columns = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), y]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "x", "y"])

    t = sample.select("text", label, *metadata).mapInArrow(run, "ids array<int>, x array<float>, y double").toArrow()
    if not t.num_rows:
        return None
    pairs = [(i.values.to_numpy(), x.values.to_numpy()) for i, x in zip(t.column("ids"), t.column("x"))]
    return FactorisationMachine().fit(pairs, (t.column("y").to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: FactorisationMachine | None, metadata: tuple[str, ...] = (), cut: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= cut, else 0) in place of columns of those names.

    Whole texts are scored; a null text counts as empty, and empty texts get the score of their
    structure. Null metadata is a value of its own. Without a model every score is 0.5. Rows that
    repeat are each scored, to equal scores; an empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    sent = shared(docs.sparkSession, model)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for b in batches:
            p = []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                p.append(np.full(part.num_rows, 0.5) if model is None else model.score(list(_rows(part, metadata))))
            p = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, schema + ", score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """score_quality of docs under a model trained on the rows of docs that `labels` (doc_id, label) marks and where `learn` holds.

    Labelled ids are joined and sampled without their texts; the sample, of 2 x TRAIN_ROWS ids at most, is
    broadcast to fetch them. A null doc_id is never labelled; of a doc_id that is labelled several times the greatest label counts.
    """
    marked = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    ids = least_hashes(docs.where(learn).select("doc_id").distinct().join(marked, "doc_id"), TRAIN_ROWS)
    labelled = docs.where(learn).select("doc_id", "text", *metadata).join(F.broadcast(ids), "doc_id")
    return score_quality(docs, train(labelled, "_label", metadata), metadata)


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").withColumn("held_out", crc_fold(5) == 0)
    scored = classify(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted")
