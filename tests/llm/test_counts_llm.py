"""Token counts against the tokenizer's library, filter interactions against every order run one by one, phrases against plain counting; and odd rows."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidegauge.llm import filter_audit, phrases, token_counts
from tidegauge.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{k % 311} and  {k % 7}\n" for k in range(60_000))
ODD = [(1, "two words", "a"), (1, "two words", "a"), (2, None, None), (3, "", "a"), (4, LONG, "b"), (None, "Two words", None), (5, "é中 \U0001f600 ß▁x", "a"), (6, "  lead and  gaps  \t\r\n ", "b"), (7, "x" * 5000, "b"), (8, "<s> </s> <unk>", "a")]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    return df.withColumns({c: F.lit("mine") for c in ("row", "n_tokens", "names", "part", "rank", "phrase", "n", "score", "A", "_id", "filter", "kept", "digest", "h", "a.b")})


def test_op11_counts_as_the_library_does(spark, library):
    rows = QUERIES["op11_token_counts"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {d: (len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts.items()}


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 17, 1 << 19, 128), (2, 4, 3, 2), (0, 4, 0, 1)])
def test_token_counts_of_odd_rows_with_tiers_of_any_size(spark, library, monkeypatch, sizes):
    for name, value in zip(("FREQUENT", "SUMMARY", "CACHED", "ROWS"), sizes):
        monkeypatch.setattr(token_counts, name, value)
    monkeypatch.setattr(token_counts, "MERGED", 2)
    out = token_counts.token_counts(odd(spark).repartition(5), MODEL, limit=3, entries=sizes[0])
    assert out.columns[:4] == ["doc_id", "source", "lang", "row"] and out.columns[-3:] == ["n_bytes", "n_tokens", "over_limit"] and out.where("row = 'mine' and `a.b` = 'mine'").count() == len(ODD)
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 3) for d, t, _ in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want


def test_token_counts_of_an_empty_table_and_of_text_alone(spark):
    assert token_counts.token_counts(odd(spark, []), MODEL).collect() == []
    assert [tuple(r) for r in token_counts.token_counts(spark.createDataFrame([("a b",)], "text string"), MODEL).collect()] == [(3, 2, False)]


def test_pretokens_of_random_texts_add_up(library):
    pieces, draw = token_counts.Pieces(open(MODEL, "rb").read()), random.Random(3)
    letters = [" ", "  ", "▁", "\n", "\t", "a", "the", "erty", "é", "日本", "<s>", "\x00", "　", "ﬁ", ".", "  \n", "\U0001f642", "́", "‍"]
    for _ in range(5000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 12)))
        assert sum(pieces.lengths(pieces.split(text))) == len(library.encode(text)), repr(text)


def test_frequent_pretokens_come_from_all_texts(spark):
    rows = [(f"common{k % 3} rare{k} " + "late " * (k > 900),) for k in range(1000)]
    found = token_counts.frequent(spark.createDataFrame(rows, "text string").repartition(6), open(MODEL, "rb").read(), 4)
    assert set(found) == {"common0", "common1", "common2", "late"}


@pytest.mark.parametrize("letters", ["A", "AB", "ABC", "ABCD"])
def test_interactions_match_orders_run_one_by_one(spark, letters):
    draw = random.Random(len(letters))
    rows = [(draw.choice(["x", "y", None]), *[draw.choice([True, False, None]) for _ in letters], draw.choice([True, False, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "part string, " + ", ".join(f"{c} boolean" for c in letters) + ", good boolean")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(df, "part", list(letters), {"good_lost": F.col("good")}).collect()}
    assert len(got) == 3 * len(list(permutations(letters))) * len(letters)
    for part in ("x", "y", None):
        docs = [({c for c, v in zip(letters, r[1:-1]) if v}, bool(r[-1])) for r in rows if r[0] == part]
        game = Counter()
        for order in map("".join, permutations(letters)):
            left = docs
            for k, c in enumerate(order):
                r, gone = got[part, order, k + 1], [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                game[c] += len(gone)
                alone, failing = sum(x[0] == {c} for x in docs), sum(c in x[0] for x in docs)
                assert (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost) == (c, len(left), len(gone), failing - len(gone), alone, sum(g for _, g in gone))
        assert all(r.shapley == game[r.filter] for (p, _, _), r in got.items() if p == part)


def test_audit_of_odd_rows(spark):
    rows = [(1, "same text", "a"), (1, "same text", None), (3, "same text", "a"), (None, "same text", "a"), (None, "alone", "a"), (4, None, ""), (5, "", None), (6, " \t", "b"), (7, "word " * 49 + "$", "b"), (8, " ".join(map(str, range(50))) + " ABC", "b"), (9, "é" * 20 + "A", "b")]
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (3, 1, None), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    flags = filter_audit.flagged(odd(spark, rows), labels).collect()
    letters = Counter((r.part, "".join(c for c in "ABCDE" if r[c]), r.good, r.toxic) for r in flags)
    assert letters == Counter([("a", "A", True, True), ("", "A", True, True), ("a", "AE", True, False), ("a", "AE", False, False), ("a", "A", False, False), ("", "A", False, False), ("", "AE", False, False), ("b", "A", False, False), ("b", "BD", False, True), ("b", "", False, False), ("b", "A", False, False)])
    assert filter_audit.flagged(odd(spark, []), labels).collect() == [] and filter_audit.interactions(filter_audit.flagged(odd(spark, []), labels), "part", list("ABCDE")).collect() == []
    with pytest.raises(ValueError):
        filter_audit.interactions(odd(spark), "part", list("ABCDEFG"))


def test_intervals_match_plain_counting():
    draw = np.random.default_rng(4)
    for size, vocab in ((0, 3), (1, 1), (40, 2), (400, 4), (400, 60)):
        ids = draw.integers(-1, vocab, size).astype(np.int32)
        pieces = [p.split() for p in " ".join("|" if i < 0 else str(i) for i in ids).split("|")]
        for short, long in ((1, 1), (2, 2), (1, 5), (3, 5)):
            want = {k: Counter(tuple(p[i : i + k]) for p in pieces for i in range(len(p) - k + 1)) for k in range(short, long + 1)}
            got = {k: Counter({tuple(map(str, ids[a : a + k])): int(n) for a, n in zip(at, counts)}) for k, at, counts in phrases.intervals(ids, short, long)}
            assert {k: c for k, c in want.items() if c} == got
            kept = phrases._runs(ids, short)
            assert {k: Counter({tuple(map(str, kept[a : a + k])): int(n) for a, n in zip(at, counts)}) for k, at, counts in phrases.intervals(kept, short, long)} == got


def test_suffixes_are_ordered_in_ranges(monkeypatch):
    draw = np.random.default_rng(8)
    monkeypatch.setattr(phrases, "RANGE", 16)
    for ids in (draw.integers(-1, 9, 700).astype(np.int32), np.zeros(90, np.int32)):
        pieces = [p.split() for p in " ".join("|" if i < 0 else str(i) for i in ids).split("|")]
        for short, long in ((1, 1), (2, 2), (2, 5)):
            got = [(tuple(map(str, ids[a : a + k])), int(n)) for k, at, counts in phrases.intervals(ids, short, long) for a, n in zip(at, counts)]
            assert len(got) == len(dict(got)) and dict(got) == Counter(tuple(p[i : i + k]) for p in pieces for k in range(short, long + 1) for i in range(len(p) - k + 1))


def test_a_shard_is_counted_in_the_memory_of_a_range(monkeypatch):
    monkeypatch.setattr(phrases, "RANGE", 1 << 15, raising=False)
    ids = np.random.default_rng(9).integers(-1, 40_000, 1 << 20).astype(np.int32)
    tracemalloc.start()
    try:
        rows = sum(len(at) for _, at, _ in phrases.intervals(ids, 2, 5))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 1 << 20 and most < 16 << 20  # the whole suffix array took over 60 MB


def test_tasks_hold_few_shards_at_a_time(spark, monkeypatch):
    groups, plain_written, key = [], phrases.written, "spark.sql.execution.arrow.maxBytesPerBatch"

    def written(df, **options):
        out = plain_written(df, **options)
        if "ids" in out.columns:
            files = [pq.ParquetFile(f).metadata for f in Path(out._folder.removeprefix("file:")).glob("*.parquet")]
            groups.append([m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)])
        else:
            batches = phrases_cut(df.sparkSession).mapInArrow(lambda bs: (pa.record_batch({"n": [b.num_rows]}) for b in bs), "n long").collect()
            groups.append([r.n for r in batches])
        return out

    def phrases_cut(session):
        return session.createDataFrame([(bytes(1 << 13),)] * 12, "ids binary").coalesce(1)

    for name, value in (("SHARD", 1 << 13), ("HELD", 1 << 12), ("GROUPS", {k: v if v == 1 else 1 << 12 for k, v in phrases.GROUPS.items()})):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases, "written", written)
    before = spark.conf.get(key)
    text = " ".join(f"w{i % 800}" for i in range(2000))
    found = phrases.collocations(spark.createDataFrame([(text, "en")] * 12, "text string, lang string").coalesce(1), least=20)
    assert found.count() > 0 and spark.conf.get(key) == before
    assert len(groups) == 4 and all(sum(g) == 12 and max(g) <= 2 for g in groups)


def plain(docs, longest, least, scale, inside, top):
    """Collocations by counting in dictionaries."""
    counts, out = {}, []
    for text, lang in docs:
        f = counts.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for p in __import__("re").split("[.,;:!?\n-\r]", low):
            w = [x for x in p.replace("\t", " ").split(" ") if x]
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n, often, rows = sum(v for g, v in f.items() if len(g) == 1), {g: v for g, v in f.items() if v >= least}, []
        for g, a in often.items():
            within = [v for h, v in often.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if len(g) < 2 or any(100 * v >= inside * a for v in within):
                continue
            score, k = min((scale * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("longest,least,inside,top", [(5, 4, 100, 40), (3, 2, 60, 7), (2, 5, 100, 1000)])
def test_collocations_match_plain_counting(spark, monkeypatch, small, longest, least, inside, top):
    draw = random.Random(longest)
    words = ["New", "york", "city", "of", "the", "été", "a.b", "x\x0by", "Z", " ", "naïve", "THE"]
    docs = [("  ".join(draw.choice(words[: draw.randint(1, 12)]) + draw.choice(["", "", "", ".", "\t", "!", "\n"]) for _ in range(draw.randint(0, 40))), draw.choice(["en", "en", "fr", None])) for _ in range(150)]
    docs += [(None, "en"), ("", None), ("only here", "xx"), ("New york city. " * 300, "en")]
    if small:  # many shards, and bit maps that hold nearly every hash
        monkeypatch.setattr(phrases, "SHARD", 300)
        monkeypatch.setattr(phrases, "CHUNK", 70)
        monkeypatch.setattr(phrases, "LEAST_BITS", 64)
        monkeypatch.setattr(phrases, "MOST_BITS", 64)
        monkeypatch.setattr(phrases, "PARTS", 2)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, longest, least, 1000, inside, top).collect())
    assert got == plain(docs, longest, least, 1000, inside, top) and got


def test_phrases_of_odd_rows(spark):
    out = phrases.collocations(odd(spark), least=2)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == plain([(t, "en" if d is not None and d % 2 == 0 else None) for d, t, _ in ODD], 5, 2, 1000, 100, 2000)
    assert phrases.collocations(odd(spark, [])).collect() == []


def test_scores_are_exact_past_64_bits(spark):
    row = spark.createDataFrame([(9_999_999_999, 8_000_000_000_000_007, 10_000_000_000, 10_000_000_001)], "a long, n long, l long, r long")
    row = row.select(phrases._times(F.lit(1000), "a", "n").alias("up"), phrases._times("l", "r").alias("down"))
    assert row.select(F.expr("up div down")).first()[0] == 1000 * 9_999_999_999 * 8_000_000_000_000_007 // (10_000_000_000 * 10_000_000_001)
