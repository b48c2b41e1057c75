"""The operators' queries: SQL where there is some, held-out quality where a model is learnt, brute force on small tables otherwise."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pyarrow.parquet as pq
import pytest

from tidegauge.llm.queries import ORACLES, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    compare.same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_op1_brings_back_every_payload(spark, texts):
    rows = QUERIES["op1_media_avi"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])


def test_op3_matches_alignment_of_every_pair(spark, texts):
    from tidegauge.llm.decontaminate import EDIT, MATCH, words

    def share(item, doc):  # plain Smith-Waterman of (score, matches)
        best, top = [(0, 0)] * (len(doc) + 1), (0, 0)
        for w in item:
            row = [(0, 0)]
            for j, v in enumerate(doc):
                s, m = best[j]
                moves = [(s + MATCH, m + 1) if v == w else (s + EDIT, m), (best[j + 1][0] + EDIT, best[j + 1][1]), (row[j][0] + EDIT, row[j][1])]
                row.append(max([x for x in moves if x[0] >= 0], default=(0, 0)))
            best = row
            top = max(top, max(row))
        return top[1] / len(item)

    items = pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()
    short = {d: words(t) for d, t in texts.items()}
    expected = set()
    for i in items:
        ws = words(i["text"])
        for d, doc in short.items():
            if sum((Counter(ws) & Counter(doc)).values()) >= 0.8 * len(ws) and share(ws, doc) >= 0.8:
                expected.add((d, i["item_id"]))
    found = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontaminate"](spark, SMALL).collect()}
    assert found <= expected
    assert len(found) >= 0.9 * len(expected)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_op5_matches_plain_counting(spark, texts, order):
    from tidegauge.llm.lm_scoring import stupid_backoff

    split = {d: (t or "").split() for d, t in texts.items()}
    counts = Counter(tuple(ws[k : k + n]) for ws in split.values() for n in range(1, order + 1) for k in range(len(ws) - n + 1))
    total = sum(map(len, split.values()))
    for r in stupid_backoff(spark.read.parquet(f"{SMALL}/documents.parquet"), order).collect():
        ws, want = split[r.doc_id], 0.0
        for k in range(len(ws)):
            back = 0.0
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(ws[k - n + 1 : k + 1])
                if n == 1 or counts[gram] >= 2:
                    want += back + math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total))
                    break
                back += math.log(0.4)
        assert r.n_words == len(ws) and math.isclose(r.log_score, want, rel_tol=1e-9, abs_tol=1e-9)


def test_op6_matches_all_pairs(spark, texts):
    import xxhash

    def fingerprint(t):
        ws = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        shingles = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {d: fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SMALL).collect()}
    assert got == {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def test_op8_names_held_out_languages(spark):
    rows = QUERIES["op8_language_id"](spark, MIDDLE).where("held_out").collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{MIDDLE}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    known = [r for r in rows if lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in known]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def brute_dedup(rows, length=50):
    """doc_id -> (bytes, mask of removed ones), by every window of every document."""
    raw = {d: (t or "").encode() for d, t in rows}
    first = {}
    for d in sorted(raw):
        for k in range(len(raw[d]) - length + 1):
            first.setdefault(raw[d][k : k + length], d)
    out = {}
    for d, r in raw.items():
        off = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if first[r[k : k + length]] < d:
                off[k : k + length] = True
        out[d] = (r, off)
    return out


def test_op9_matches_every_window(spark, texts):
    want = {}
    for d, (r, off) in brute_dedup(texts.items()).items():
        kept = np.frombuffer(r, np.uint8)[~off].tobytes()
        spans = int(np.count_nonzero(np.diff(off.astype(np.int8), prepend=0) == 1))
        want[d] = (len(r), int(off.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix_dedup"](spark, SMALL).collect()}
    assert got == want


def test_op10_ranks_held_out_labels(spark):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{MIDDLE}/labels.parquet").to_pylist()}
    by = defaultdict(list)
    for r in QUERIES["op10_quality_fm"](spark, MIDDLE).where("held_out").collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if label.get(r.doc_id) is not None:
            by[label[r.doc_id]].append(r.score)
    assert np.mean([[a > b for b in by[0]] for a in by[1]]) >= 0.9
