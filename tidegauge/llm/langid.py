"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, shared, table, written

ORDER = 4
#: The bound of a stored level: values (kept grams x languages) over all languages. It bounds what is stored, not what is counted.
MODEL_VALUES = 32_000_000
#: Counts below this have a bucket each; above, sixteen buckets share a doubling.
EXACT = 1 << 10
#: Texts longer than PART characters are read in parts of that length; texts are taken together until they have TOGETHER.
PART, TOGETHER = 1 << 20, 1 << 17
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_END = "\uffff"
#: For each UTF-16 unit, itself if it is a letter, else a space; the end mark stays.
_LETTER = np.array([i if chr(i).isalpha() or chr(i) == _END else 32 for i in range(1 << 16)], np.uint16)


def letters(units: np.ndarray) -> np.ndarray:
    """UTF-16 units with a space for each that is no letter; the halves of a character are judged by its code point, lone halves are no letters."""
    out, head = _LETTER[units], np.flatnonzero((units[:-1] & 0xFC00) == 0xD800)
    head = head[(units[head + 1] & 0xFC00) == 0xDC00]
    if len(head):
        point = 0x10000 + ((units[head].astype(np.int64) & 0x3FF) << 10 | units[head + 1].astype(np.int64) & 0x3FF)
        kinds, which = np.unique(point, return_inverse=True)
        head = head[np.array([chr(c).isalpha() for c in kinds.tolist()])[which]]
        out[head], out[head + 1] = units[head], units[head + 1]
    return out


def parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts, by row number, in lists of about TOGETHER characters, or of one part."""
    rows, held, many = [], [], 0
    for i, t in enumerate(texts):
        t = (t or "").replace(_END, " ")
        for at in range(0, max(1, len(t)), PART):
            rows.append(i)
            held.append(t[at : at + PART])
            many += len(held[-1])
            if many >= TOGETHER:
                yield np.array(rows), held
                rows, held, many = [], [], 0
    if rows:
        yield np.array(rows), held


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, start, stop): each run of four units as one 64-bit number, a hash without collisions, and where each text's grams are.

    A text is its letters, lower-cased, as UTF-16 units, with one space for any gap, three spaces in
    front and one behind; a text without a letter has no grams.
    """
    u = letters(np.frombuffer(_END.join(texts).lower().encode("utf-16-le", "surrogatepass"), np.uint16))
    edge = u == 32
    edge |= u == 0xFFFF
    u = u[~((u == 32) & np.r_[True, edge[:-1]][: len(u)])]
    end = u == 0xFFFF
    u = u[~((u == 32) & np.r_[end[1:], True][: len(u)])]
    ends = np.flatnonzero(u == 0xFFFF)
    size = np.diff(np.r_[-1, ends, len(u)]) - 1
    start = np.cumsum(size + 4) - size - 4
    out = np.full(int((size + 4).sum()), 32, np.uint64)
    kept = u[u != 0xFFFF]
    out[np.arange(len(kept)) + np.repeat(4 * np.arange(len(size)) + 3, size)] = kept
    g = out[:-3] << np.uint64(48) | out[1:-2] << np.uint64(32) | out[2:-1] << np.uint64(16) | out[3:]
    return g, start, np.where(size > 0, start + size + 1, start)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(n, at) if len(at) else n


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs (text, lang); each task sends a sum for each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            texts = b.column(0).to_pylist()
            for lang in sorted(set(langs)):
                for _, some in parts([texts[i] for i in np.flatnonzero(langs == lang)]):
                    g, start, stop = grams(some)
                    own = np.zeros(len(g) + 1, np.int8)
                    np.add.at(own, start, 1)
                    np.add.at(own, stop, -1)
                    g = np.sort(g[np.cumsum(own[:-1]) > 0])
                    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
                    keys, counts, size = held.setdefault(lang, [[], [], 0])
                    keys.append(g[at])
                    counts.append(np.diff(np.r_[at, len(g)]))
                    held[lang][2] = size + len(at)
                    if held[lang][2] > 1 << 20:
                        k, n = _summed(keys, counts)
                        held[lang] = [[k], [n], min(len(k), 1 << 19)]
        for lang, (keys, counts, _) in held.items():
            k, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Distinct 64-bit keys in order of their hash, found through an index of the hash's leading bits."""

    def __init__(self, keys: np.ndarray):
        hashed = keys * _ODD
        self.order = np.argsort(hashed)
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(hashed[self.order], np.uint64(0))
        self.first = np.searchsorted(hashed[self.order] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each x."""
        h = x * _ODD
        at = self.first[(h >> self.shift).astype(np.int64)]
        hit = self.keys[at] == h
        hit &= at < len(self.order)
        todo = np.flatnonzero(~hit)
        last = len(self.order) - 1
        while len(todo):
            todo = todo[(at[todo] < last) & (self.keys[np.minimum(at[todo], last)] < h[todo])]
            at[todo] += 1
            found = self.keys[at[todo]] == h[todo]
            hit[todo[found]] = True
            todo = todo[~found]
        return np.minimum(at, max(last, 0)), hit


class KneserNey:
    """All languages' models: for each order, hash arrays of grams with log probabilities and of contexts with back-off weights, a row a language."""

    def __init__(self, langs: list[str], units: int, levels: list[tuple]):
        """From the number of units and, from single units up, (row, gram, share, row, context, weight): a gram's discounted share of its context, a context's back-off weight."""
        self.langs, self.base, self.levels = langs, -np.log(units + 1), []
        for k, (row, gram, share, at, context, back) in enumerate(levels):
            keys, ctx = np.unique(gram), np.unique(context)
            weight = np.zeros((len(langs), len(ctx)), np.float32)
            weight[at, np.searchsorted(ctx, context)] = np.log(back)
            seen = np.full((len(langs), len(keys)), -np.inf)
            seen[row, np.searchsorted(keys, gram)] = np.log(share)
            at_key, at_ctx = HashArray(keys), HashArray(ctx)
            self.levels.append((at_key, None, at_ctx, weight[:, at_ctx.order]))
            value = np.logaddexp(seen, self._backed_off(keys, k)).astype(np.float32)
            self.levels[k] = (at_key, value[:, at_key.order], at_ctx, weight[:, at_ctx.order])

    def _backed_off(self, gram: np.ndarray, k: int) -> np.ndarray:
        """log(weight of the context x probability one order down) of grams of order k + 1, a row a language."""
        down = self.log_p(gram & np.uint64((1 << 16 * k) - 1), k - 1) if k else np.full((len(self.langs), len(gram)), self.base)
        _, _, ctx, weight = self.levels[k]
        at, hit = ctx.find(gram >> np.uint64(16))
        return down + np.where(hit, np.take(weight, at, axis=1), 0)

    def log_p(self, gram: np.ndarray, k: int = ORDER - 1) -> np.ndarray:
        keys, value, _, _ = self.levels[k]
        at, hit = keys.find(gram)
        out = np.stack([np.take(v, at) for v in value])
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[:, miss] = self._backed_off(gram[miss], k)
        return out

    def alone(self, row: int) -> KneserNey:
        """The model of one language, of the same values."""
        one = copy(self)
        one.langs, one.levels = self.langs[row : row + 1], [(keys, value[row : row + 1], ctx, weight[row : row + 1]) for keys, value, ctx, weight in self.levels]
        return one


def _bucket(n: Column) -> Column:
    """A number that grows with a count: the count itself below EXACT, then sixteen steps a doubling."""
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(16 * F.log2(n / EXACT)))


def _levels(counts: DataFrame) -> DataFrame:
    """(level, lang, gram, n): counts at ORDER, and below in how many contexts a shorter gram continues."""
    now, out = counts.select("lang", "gram", "n"), None
    for k in range(ORDER, 0, -1):
        own = now.select(F.lit(k).alias("level"), "lang", "gram", "n")
        out = own if out is None else out.union(own)
        if k > 1:
            short = F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))
            now = now.groupBy("lang", short.alias("gram")).agg(F.count("*").alias("n"))
    return out


def _cuts(rows: DataFrame, most: int) -> dict[tuple[int, str], tuple[int, float]]:
    """(level, lang) -> the least bucket of which and all above at most `most` rows are, or else the highest; and the discount from all n1 and n2."""
    found: dict[tuple[int, str], list] = {}
    for r in rows.groupBy("level", "lang", _bucket(F.col("n")).alias("b")).agg(F.count("*").alias("m")).collect():
        found.setdefault((r.level, r.lang), []).append((r.b, r.m))
    out = {}
    for key, buckets in found.items():
        many = dict(buckets)
        n1, n2 = many.get(1, 0), many.get(2, 0)
        cut, total = max(many), 0
        for b in sorted(many, reverse=True):
            total += many[b]
            if total > most:
                break
            cut = b
        out[key] = cut, min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
    return out


def _kept(rows: DataFrame, cuts: dict[tuple[int, str], tuple[int, float]]) -> DataFrame:
    """rows of a bucket at or above their level's and language's cut, with its discount d."""
    named = F.broadcast(rows.sparkSession.createDataFrame([(*k, *v) for k, v in cuts.items()], "level int, lang string, cut long, d double"))
    return rows.join(named, ["level", "lang"]).where(_bucket(F.col("n")) >= F.col("cut"))


def fit(docs: DataFrame) -> KneserNey | None:
    """Models of every language in docs (text, lang; rows of null lang are left out); None if there are none.

    Discounts, continuation counts and back-off weights come from the counts of all grams of all
    rows. What is stored of a level and language is its most frequent grams and contexts, MODEL_VALUES /
    languages^2 of them at most, so that the model can be sent to every executor; a gram that is not
    stored is scored through its context's weight, as an unseen one is.
    """
    counts = written(gram_counts(docs.where(F.col("lang").isNotNull()).select("text", "lang")))
    levels = written(_levels(counts))
    ctx = F.shiftrightunsigned("gram", 16)
    contexts = written(levels.groupBy("level", "lang", ctx.alias("ctx")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model = None
    if langs:
        most = max(1, MODEL_VALUES // len(langs) ** 2)
        cuts = _cuts(levels, most)
        total = contexts.select("level", "lang", "ctx", F.col("n").alias("total"))
        grams = _kept(levels, cuts).withColumn("ctx", ctx).join(total, ["level", "lang", "ctx"])
        kept = grams.select("level", "lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("share")).toArrow()
        wide = {k: (c, cuts[k][1]) for k, (c, _) in _cuts(contexts, most).items()}
        backs = _kept(contexts, wide).select("level", "lang", "ctx", (F.col("d") * F.col("kinds") / F.col("n")).alias("weight")).toArrow()
        units = levels.where("level = 1").select("gram").distinct().count()
        model = KneserNey(langs, units, [(*_columns(kept, k, langs), *_columns(backs, k, langs)) for k in range(1, ORDER + 1)])
    discard(counts, levels, contexts)
    return model


def _columns(t: pa.Table, level: int, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, value) of one level."""
    own = t.column("level").to_numpy() == level
    row = np.searchsorted(np.array(langs), np.array(t.column("lang").to_pylist(), object)[own].astype(str))
    return row, t.column(2).to_numpy()[own].view(np.uint64), t.column(3).to_numpy()[own]


def entropies(model: KneserNey, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy for each unit (nats) of each whole text in each language, and the numbers of units."""
    total, size = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    for rows, some in parts(texts):
        g, start, stop = grams(some)
        ends = np.column_stack([start, np.maximum(stop, start + 1)]).ravel()
        used = stop > start
        np.add.at(size, rows, stop - start)
        for j, lp in enumerate(model.log_p(g)):
            sums = np.add.reduceat(np.append(lp, np.zeros(4, lp.dtype)), ends, dtype=float)[::2]
            np.add.at(total[:, j], rows[used], sums[used])
    return -total / np.maximum(size, 1)[:, None], size


def least_hashes(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of df, twice as many at most: those whose hash of all columns is in the lowest share. No rows are sorted or moved to tell."""
    n = df.count()
    share = min(1.0, rows / max(n, 1))
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).limit(2 * rows)


def limits(model: KneserNey, docs: DataFrame, rows: int | None = None) -> np.ndarray:
    """For each language, the mean of its own texts' cross-entropy and the spread of one unit, over all of its rows in docs.

    Sums for each language are made in the tasks. A caller may ask for about `rows` rows instead, an equal part of each
    language's; `identify` does not. A language of fewer than five texts takes the spread over all languages' texts, and
    the mean over these or its own, whichever is greater.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isin(model.langs))
    if rows is not None:
        many = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
        shares = [(x, int(min(1.0, rows / max(len(many), 1) / n) * (1 << 40))) for x, n in many.items()]
        least = F.pmod(F.xxhash64(*known.columns), F.lit(1 << 40))
        known = known.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long")), "lang").where(least < F.col("share"))
    sent = shared(docs.sparkSession, model)

    def run(batches):
        model = sent()
        alone = [model.alone(k) for k in range(len(model.langs))]
        sums = np.zeros((4, len(alone)))
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for lang in set(langs):
                j = model.langs.index(lang)
                h, n = entropies(alone[j], [texts[i] for i in np.flatnonzero(langs == lang)])
                h = h[n > 0, 0]
                n = n[n > 0]
                sums[:, j] += len(n), n.sum(), (n * h).sum(), (n * h * h).sum()
        own = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, sums[:, own])], ["j", "texts", "n", "nh", "nhh"])

    each = known.select("text", "lang").mapInArrow(run, "j long, texts double, n double, nh double, nhh double")
    exact = [F.sum(F.col(c).cast("decimal(38,12)")).cast("double").alias(c) for c in ("texts", "n", "nh", "nhh")]  # the order of tasks doesn't show
    sums = np.zeros((len(model.langs), 4))
    for r in each.groupBy("j").agg(*exact).collect():
        sums[r.j] = r.texts, r.n, r.nh, r.nhh

    def measured(texts: float, n: float, nh: float, nhh: float) -> tuple[float, float]:
        mean = nh / n
        return mean, np.sqrt(max(nhh - mean * nh, 0.0) / texts)

    out = np.full((len(model.langs), 2), np.inf)  # stays where there is no text with a letter at all
    for k, own in enumerate(sums):
        if own[0] >= 5:
            out[k] = measured(*own)
        elif sums[:, 0].any():
            mean, spread = measured(*sums.sum(axis=0))
            out[k] = max(mean, measured(*own)[0]) if own[0] else mean, spread
    return out


def identify(docs: DataFrame, learn: Column | None = None, width: float = 8.0, slack: float = 0.35) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy and rejected in place of columns of those names.

    Models are learnt from text and non-null lang of rows where `learn` holds (all by default).
    lang_pred has the least cross-entropy for each letter or gap over the whole text, ties to the first name; score is its
    posterior at no more than 50 units. rejected: no letter, or a cross-entropy above that of the
    language's own texts by `slack` nats and `width` standard errors, over all learning rows.
    A null or letterless text is `und` with score 0 and null cross_entropy. With nothing to learn
    from, all texts are `und` and only letterless ones are rejected. An empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    rows = (docs if learn is None else docs.where(learn)).select(*dict.fromkeys(["text", "lang", *docs.columns[:1]]))
    model = fit(rows)
    bounds = limits(model, rows) if model else None
    sent = shared(docs.sparkSession, (model, bounds))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bounds = sent()
        for b in batches:
            texts = b.column(names.index("text")).to_pylist()
            if model is None:
                some = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
                pred, score, h, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), ~some
            else:
                e, size = entropies(model, texts)
                best = e.argmin(axis=1)
                low = e.min(axis=1)
                score = np.where(size > 0, 1 / np.exp(-(e - low[:, None]) * np.minimum(size, 50)[:, None]).sum(axis=1), 0.0)
                mean, spread = bounds[best, 0], bounds[best, 1]
                out = (size == 0) | (low > mean + slack + width * spread / np.sqrt(np.maximum(size, 1)))
                pred = [model.langs[k] if s else UNKNOWN for k, s in zip(best, size)]
                h = [x if s else None for x, s in zip(low.tolist(), size)]
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*names, "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.mapInArrow(run, schema + ", lang_pred string, score double, cross_entropy double, rejected boolean")


def crc_fold(folds: int) -> Column:
    """crc32 of doc_id as text (null as empty), modulo folds."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_fold(3) == 1)
    return identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
