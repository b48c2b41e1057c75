"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; each operator's own paths."""

from __future__ import annotations

import math
import os
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from test_queries_llm import brute_dedup

from tidegauge.llm import decontaminate, langid, licenses, lm_scoring, media, mixing, phrases, quality, simhash, suffix_dedup, token_counts, url_filter
from tidegauge.llm import components as components_module
from tidegauge.llm.components import components

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, rate double, kept string, verdict string"
WORDS = "the quick brown fox jumps over the lazy dog while seven small boats sail past a quiet harbour at dawn and nobody on the pier looks up".split()
LONG = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(60_000))


def rows_of(texts):
    return [(d, t, "en", "web", len(t or ""), 0.5, "x", 1.0, "k", "v") for d, t in texts]


ODD = rows_of([(1, " ".join(WORDS)), (1, " ".join(WORDS)), (2, None), (3, ""), (4, LONG), (5, " ".join(WORDS)), (None, "no id here"), (6, "é中 \U0001f600 ß"), (7, " \t\n")])
ODD.append((8, None, None, None, None, None, None, None, None, None))


def operators(spark):
    items = spark.createDataFrame([(1, " ".join(WORDS)), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    every = langid.crc_fold(3) >= 0
    return {
        "media": media.store_texts,
        "licenses": lambda d: licenses.license_scan(d, licenses.known_licenses(spark)),
        "decontaminate": lambda d: decontaminate.contaminated(d, items),
        "lm_scoring": lm_scoring.stupid_backoff,
        "simhash": simhash.near_duplicates,
        "mixing": mixing.poisson_mix,
        "langid": langid.identify,
        "suffix_dedup": suffix_dedup.dedup_substrings,
        "quality": lambda d: quality.classify(d, labels, every),
    }


NAMES = ["media", "licenses", "decontaminate", "lm_scoring", "simhash", "mixing", "langid", "suffix_dedup", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    out = operators(spark)[name](spark.createDataFrame(ODD, SCHEMA))
    assert len(out.columns) == len(set(out.columns))
    n = len(out.collect())
    if name not in ("decontaminate", "mixing"):
        assert n == len(ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_decontaminate_finds_edited_copies_and_nothing_else(spark):
    docs = spark.createDataFrame([(1, "intro " + " ".join(WORDS[:12] + ["oddly"] + WORDS[13:]) + " end"), (2, " ".join(WORDS[::-1])), (3, " ".join(WORDS[:9]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(WORDS)), (7, " ".join(WORDS))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7), (1, 7)]


def test_decontaminate_loses_no_alignment_whatever_is_common(spark):
    draw = np.random.default_rng(9)
    items = [[f"w{k}" for k in draw.integers(0, 400, n)] for n in (5, 15, 15, 25, 37)]
    docs = []
    for ws in items * 20:  # a fifth of the words edited, in runs or spread, words added; the first half is in all
        half = len(ws) // 2
        new = list(ws)
        at = draw.choice(range(half, len(ws)), len(ws) // 5, replace=False) if len(docs) % 2 else np.arange(len(ws) // 5) * 5 + 4
        for k in at:
            new[k] = "odd"
        if len(docs) % 3 == 0:
            new = [x for w in new for x in (w, "added")]
        docs.append(" ".join([*(f"w{k}" for k in draw.integers(0, 400, 30)), *new, "end"]))
    docs += [" ".join(ws[: len(ws) // 2]) for ws in items for _ in range(150)]
    numbers = {}
    ids = lambda ws: np.array([numbers.setdefault(w, len(numbers) + 1) for w in ws])
    score = {(d, i): decontaminate.aligned(ids(ws), ids(t.split())) for d, t in enumerate(docs) for i, ws in enumerate(items)}
    want = {k for k, s in score.items() if s >= 0.8}
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(rows, tests).collect()}
    assert len(want) > 60 and want <= set(got) and all(s >= 0.8 for s in got.values())
    assert set(got) == want


@pytest.mark.parametrize(("bucket", "group"), [(64, 20_000), (1, 20_000), (1, 1)])
@pytest.mark.parametrize("tau", [0, 2, 4])
def test_links_connect_all_near_fingerprints(spark, tau, bucket, group):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 4), replace=False)) for b in base for _ in range(12)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.near_links(df, tau, bucket, group)).collect()}
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    assert len({find(k) for k in range(len(fps))}) == len({got.get(x, x) for x in signed})
    for i in range(len(fps)):
        for j in range(i):
            assert (find(i) == find(j)) == (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j]))


def test_thresholds_cover_the_radius():
    both = np.full((64, 64), 25.0)
    np.fill_diagonal(both, 50.0)
    for tau in (0, 2, 4, 6):
        assert sum(t + 1 for _, t in simhash.allocate(100, both, np.arange(5000, dtype=np.uint64) ** np.uint64(4), tau)) == tau + 1


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup_matches_every_window(spark, length, monkeypatch):
    draw = np.random.default_rng(5)
    pool = ["".join(draw.choice(list("abé中"), 90)) for _ in range(6)]
    texts = [(d, "".join(pool[k] for k in draw.integers(0, 6, draw.integers(0, 5))) + str(d)) for d in range(60)]
    texts += [(60, "ab" * 900), (61, "ab" * 700), (62, None), (63, "")]
    want = brute_dedup(texts, length)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for hot in (suffix_dedup.HOT, 1):  # the second deals every anchor out by window
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        for r in suffix_dedup.dedup_substrings(docs, length).collect():
            raw, off = want[r.doc_id]
            assert (r.n_bytes, r.n_removed) == (len(raw), int(off.sum()))
            assert bytes(r.kept) == np.frombuffer(raw, np.uint8)[~off].tobytes()
    for r in suffix_dedup.dedup_substrings(docs, length, characters=True).collect():
        bytes(r.kept).decode("utf-8")
        assert r.n_removed >= int(want[r.doc_id][1].sum())


def test_url_aliases_share_a_block_and_allow_goes_first(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://a.org/x", link("http://b.net/y")), (2, "http://b.net/y", None), (3, "http://c.org/z", "plain"), (4, None, None), (5, "no scheme", ""),
        (6, "http://d.org/q", '<meta http-equiv="refresh" content="0; url=http://e.net/r">'), (7, "http://e.net/r", link("http://example.net/en/s")), (7, "http://e.net/r", None),
        (8, "HTTP://EXAMPLE.com/de/?a", ""), (9, "http://sub.example.com/deX", ""),
    ]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), url_filter.rule_table(spark))
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert got == {
        1: (None, "block"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("net/", "block"),
        8: ("example.com/de/", "block"), 9: (None, "allow"),
    }
    assert out.count() == len(pages)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), url_filter.rule_table(spark)).collect() == []


def test_targets_are_resolved(spark):
    base = "http://A.org/x/y.html?q=1#f"
    cases = {"z.html": "http://A.org/x/z.html", "../z": "http://A.org/z", "../../../z?k=/../": "http://A.org/z?k=/../", "./": "http://A.org/x/", "?p=2": "http://A.org/x/y.html?p=2", "/w": "http://A.org/w",
             "//B.org/../v/.": "http://B.org/v/", "#top": None, "mailto:x@y.z": None, "HTTPS://C.org": "HTTPS://C.org", "a:b/c": None}
    rows = spark.createDataFrame([(base, k) for k in cases], "url string, target string")
    assert {r.target: r.to for r in rows.select("target", url_filter.resolved(rows["url"], rows["target"]).alias("to")).collect()} == cases
    bare = spark.createDataFrame([("http://A.org", "z")], "url string, target string")
    assert bare.select(url_filter.page_key(url_filter.resolved(bare["url"], bare["target"]))).first()[0] == "http://a.org/z"
    pages = spark.createDataFrame([(1, "http://a.org/p", "x" * 10_000 + '<link rel=canonical href="http://b.net/p">', "u", "v"), (1, "http://a.org/p", None, None, None)], "page_id long, url string, html string, _url string, verdict string")
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark))
    assert [(r._url, r.verdict) for r in out.orderBy("_url").collect()] == [(None, "block"), ("u", "block")]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(None, 3), (5, 5), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def test_components_end_with_the_round_that_settles_them(spark, monkeypatch):
    plans, plain = [], components_module.written
    monkeypatch.setattr(components_module, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    edges = [(k, 0) for k in range(1, 30)] + [(40, 50), (51, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(30)} | {k: 40 for k in (40, 50, 51)}
    assert len(plans) == 2 and plans[1].count("Exchange hashpartitioning") <= 5


def test_licences_are_found_however_they_are_written(spark):
    known = licenses.known_texts()
    wrapped = lambda t: "\n".join(textwrap.fill(x, 80) for x in t.split("\n"))
    docs = [(k, name, "Copyright 2020 Someone Else. All rights reserved.\n\n" + wrapped(t)) for k, (name, t) in enumerate(known)]
    docs += [(k, name, t.replace("license", "LICENCE").replace(",", " ,")) for k, name, t in docs]
    docs += [(-1, None, dict(known)["MIT"] + " And more."), (-2, None, None), (-3, None, "Copyright 2020 Someone"), (-4, "MIT", "released UNDER the MIT Licence!"), (-4, "MIT", "released UNDER the MIT Licence!")]
    out = licenses.license_scan(spark.createDataFrame(docs, "doc_id int, digest string, text string"), licenses.known_licenses(spark))
    assert sorted((r.doc_id, str(r.license_id)) for r in out.collect()) == sorted((k, str(name)) for k, name, _ in docs)
    assert len({name for name, _ in known}) >= 26


def test_planted_licences_are_scanned_once(spark, tmp_path, monkeypatch):
    known, seen, plain = licenses.known_texts(), [], licenses.license_scan
    monkeypatch.setattr(licenses, "license_scan", lambda docs, k: seen.append(docs.count()) or plain(docs, k))
    ids = [*range(2 * len(known) + 3), None, -5]  # as in SQL, ids without a remainder of a known text stand for none
    spark.createDataFrame([(k, known[0][1] if k == 7 else "plain") for k in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.licence, r.license_id): r.n for r in licenses.planted(spark, str(tmp_path)).collect()}
    want = Counter((True, known[k % len(known)][0]) for k in ids if k is not None and k >= 0) + Counter({(False, None): len(ids) - 1, (False, known[0][0]): 1})
    assert got == want and sum(seen) == len(known) + len(ids)


def test_mixing_meets_its_weights(spark):
    docs = spark.createDataFrame([(k, "t", "big" if k % 10 else "rare") for k in range(20_000)], "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mixing.poisson_mix(docs, {"big": 1.0, "rare": 1.0}).groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 400 and abs(n["rare"] - 10_000) < 400
    assert mixing.poisson_mix(docs, {"big": 1.0}).where("source = 'rare'").count() == 0


def test_language_rejects_noise_and_keeps_prose(spark):
    rows = [(k, " ".join(WORDS[(k + j) % len(WORDS)] for j in range(30)), "en") for k in range(40)] + [(900, "zxq vvkw qqj xzzt wvq kkq zzx qvx jjw " * 5, None), (901, "12 34", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900].rejected and got[901].rejected and got[901].lang_pred == "und" and got[901].score == 0
    assert not any(got[k].rejected for k in range(40))


def test_rare_languages_have_rejection_limits(spark):
    draw = np.random.default_rng(2)
    prose = lambda letters: " ".join("".join(draw.choice(list(letters), 5)) for _ in range(20))
    rows = [(k, prose("abcdefgh"), "en") for k in range(3_000)] + [(5_000 + k, prose("ijklmnop"), "rare") for k in range(30)] + [(6_000 + k, prose("qrstu"), "two") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = docs.select("text", "lang", "doc_id")
    model = langid.fit(learn)
    assert np.isfinite(langid.limits(model, learn, 60)).all()
    noise = spark.createDataFrame([(9_000, "iiii pppp ijij oooo " * 10 + "zxzx yvyv wzwz vxyz yxzw zzvv xwyx " * 20, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.union(noise)).collect()}
    assert got[9_000].rejected and not any(got[5_000 + k].rejected for k in range(30))


def test_rejection_limits_are_of_all_learning_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(k, " ".join("".join(draw.choice(list("abcdefgh"), draw.integers(1, 7))) for _ in range(draw.integers(3, 12))), "en" if k % 7 else "de") for k in range(5_000)]
    rows += [(6_000, "abc fed", "few"), (6_001, None, "en"), (6_002, "12", "en")]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang", "doc_id")
    model = langid.fit(learn)
    h, n = langid.entropies(model, [t for _, t, _ in rows])
    own = {x: np.array([n[k] > 0 and lang == x for k, (_, _, lang) in enumerate(rows)]) for x in model.langs}
    h = h[np.arange(len(rows)), [model.langs.index(x) for _, _, x in rows]]

    def plain(some):
        mean = np.average(h[some], weights=n[some])
        return mean, np.sqrt(np.mean((h[some] - mean) ** 2 * n[some]))

    mean, spread = plain(n > 0)
    want = [plain(own["de"]), plain(own["en"]), (max(mean, plain(own["few"])[0]), spread)]
    assert np.allclose(langid.limits(model, learn), want, rtol=1e-9)


def test_machine_scores_pairs_as_written_out():
    m = quality.FactorisationMachine(size=12, factors=3, seed=1)
    m.w, m.b = np.arange(12) / 10, 0.2
    ids, x = [1, 4, 7], [0.5, 1.0, 2.0]
    raw = m.b + sum(m.w[i] * v for i, v in zip(ids, x)) + sum(m.v[ids[a]] @ m.v[ids[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert np.isclose(m.score([(ids, x)])[0], 1 / (1 + np.exp(-raw)))


def test_clips_of_two_shots(spark):
    dark, light = np.full((10, media.UNIT), 20, np.uint8), np.full((15, media.UNIT), 230, np.uint8)
    avi = media.write_avi(media.encode_frames(np.concatenate([dark, light])))
    files = spark.createDataFrame([(1, bytearray(avi)), (2, bytearray(b"nothing")), (3, None), (4, bytearray(avi[: avi.index(b"idx1")]))], "media_id long, media binary")
    got = {(r.media_id, r.start_frame, r.end_frame, round(r.start_s, 3), round(r.end_s, 3)) for r in media.clips(files).collect()}
    assert got == {(k, a, b, a / 25, b / 25) for k in (1, 4) for a, b in ((0, 10), (10, 25))}


def test_avi_of_several_streams_and_riff_chunks():
    frames = media.encode_frames(np.arange(6, dtype=np.uint8)[:, None].repeat(media.UNIT, 1) * 30)
    head = lambda kind, scale, rate: media._chunk(b"LIST", b"strl" + media._chunk(b"strh", media.struct.pack("<4s4sIHHIIIIIIII4H", kind, b"MJPG", 0, 0, 0, 0, scale, rate, 0, 6, 0, 0, 0, 0, 0, 0, 0)))
    hdrl = media._chunk(b"LIST", b"hdrl" + media._chunk(b"avih", bytes(56)) + head(b"auds", 1, 8000) + head(b"vids", 1001, 30000) + head(b"vids", 1, 5))
    rec = media._chunk(b"LIST", b"rec " + media._chunk(b"01dc", frames[1]) + media._chunk(b"00wb", b"abc"))
    one = media._chunk(b"LIST", b"movi" + media._chunk(b"00wb", b"sound") + media._chunk(b"01dc", frames[0]) + media._chunk(b"02dc", frames[5]) + rec + media._chunk(b"01dc", b""))
    two = media._chunk(b"LIST", b"movi" + media._chunk(b"01db", frames[3]))
    step, got = media.read_avi(media._chunk(b"RIFF", b"AVI " + hdrl + one) + media._chunk(b"RIFF", b"AVIX" + two))
    assert got == [frames[0], frames[1], frames[1], frames[3]] and step == 1001 / 30000


def test_models_and_task_functions_travel_without_the_package(spark, tmp_path):
    """What a worker unpickles is whole where this package can't be imported: models, and functions as tasks get them."""
    from pyspark import cloudpickle

    docs = spark.createDataFrame([(k, "some plain words that are here for no reason " + "abcdefghij"[k] * 9, "en") for k in range(10)], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("text", "lang", "doc_id"))
    machine = quality.FactorisationMachine(size=12, factors=3, seed=1)
    seen = {}

    def caught(self, run, schema):
        seen["run"] = run
        raise StopIteration

    kept, type(docs).mapInArrow = type(docs).mapInArrow, caught
    try:
        with pytest.raises(StopIteration):
            phrases.shards(docs)
    finally:
        type(docs).mapInArrow = kept
    (tmp_path / "sent").write_bytes(cloudpickle.dumps((model, langid.entropies, machine, decontaminate.aligned, decontaminate.Hashes, seen["run"], token_counts.Pieces)))
    code = f"""
import pickle, sys
import numpy as np, pyarrow as pa
model, entropies, machine, aligned, hashes, run, pieces = pickle.load(open({str(tmp_path / "sent")!r}, "rb"))
assert not any("tidegauge" in m and "worker" not in m for m in sys.modules), "imported"
best, _ = entropies(model, ["some plain words", None])
h = hashes().of("a b c d e")
batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([b"a b. a b", b"a b"])], ["lang", "text"])
print("FOUND", len(best), len(machine.score([([1], [1.0])])), aligned(h, h), next(run(iter([batch]))).column(1)[0])
import public_tokenizers
p = pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
print("TOKENS", sum(p.lengths(p.split("two words"))))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "FOUND 2 1 1.0 6" in out.stdout and "TOKENS 2" in out.stdout, out.stderr[-3000:]


def test_scratch_keeps_to_its_own_thread_and_cleans_up_after_failures(spark):
    import threading

    from tidegauge.llm.common import scratch, written

    inside, done, got = threading.Event(), threading.Event(), {}

    def other():
        got["frame"] = written(spark.range(3))
        inside.set()
        done.wait(60)
        got["rows"] = got["frame"].count()

    worker = threading.Thread(target=other)
    with scratch() as keep:
        worker.start()
        inside.wait(60)
        kept = written(spark.range(2))
        keep.append(kept)
        lost = written(spark.range(5))
    done.set()
    worker.join()
    assert got["rows"] == 3 and kept.count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        lost.count()
    with pytest.raises(ValueError), scratch() as outer:
        with scratch() as keep:
            keep.append(written(spark.range(7)))
        outer.append(keep[0])
        raise ValueError
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        keep[0].count()


def test_letters_are_told_by_code_point(spark):
    rows = [(1, "\U0001f600\U0001f601", "en"), (2, "\U00020000\U00020001 \u5b57", "zh"), (3, "plain words here", "en"), (4, "\u00bd 12 \u00b2 \u2603", "en"), (5, "\U0001d538\U0001d539", "sym")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[4] == ("und", 0.0) and got[2][0] == "zh" and got[3][0] == "en" and got[5][0] == "sym"


def test_pruned_language_models_stay_good(spark, monkeypatch):
    draw = np.random.default_rng(6)
    vocab = {x: ["".join(draw.choice(list(letters), draw.integers(2, 7))) for _ in range(300)] for x, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "abijklmn"))}
    rows = [(k, " ".join(draw.choice(vocab[x], 40)), x) for k, x in enumerate(list(vocab) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MODEL_VALUES", 9 * 400)  # under half of the grams of four units stay
    got = {r.doc_id: r for r in langid.identify(docs, langid.crc_fold(3) != 1).collect()}
    assert np.mean([got[k].lang_pred == x for k, _, x in rows]) > 0.97
    assert sum(r.rejected for r in got.values()) <= 2


def test_rates_of_any_size_are_inverted(spark):
    def plain(rate, u):
        k = max(0, int(rate - 12 * rate**0.5))
        total = 0.0
        while True:
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            if total > u:
                return k
            k += 1

    draw = np.random.default_rng(8)
    rows = [(float(r), float(u)) for r in (1e-3, 0.5, 1, 5, 99, 105, 170, 2500, 1e5) for u in draw.random(20)]
    out = spark.createDataFrame(rows, "rate double, u double")
    out = out.withColumns(mixing._walk(mixing.F.col("rate"))).withColumn("k", mixing._inverted(mixing.F.col("u"))).collect()
    assert all(r.k == plain(r.rate, r.u) for r in out)
    loose = spark.createDataFrame([(None, f"t{k}", "a") for k in range(2000)], "doc_id long, text string, source string")
    assert 1800 < mixing.poisson_mix(loose).count() < 2200  # rows without an id are drawn each by its text


def test_ids_of_any_type_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(WORDS), "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, _label string")
    items = spark.createDataFrame([("b-7", " ".join(WORDS)), (None, "x"), ("b-8", None)], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(docs, items).collect()] == [(1, "b-7", 1.0)]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels, langid.crc_fold(3) >= 0, metadata=())
    assert out.columns == ["doc_id", "text", "_label", "score", "predicted"] and out.count() == 3


def test_mixing_joins_large_rates_in_parts(spark, monkeypatch):
    from tidegauge.llm import mixing

    rows = [(i if i % 7 else None, None if i % 5 == 0 else "hot" if i % 3 else "cold", f"t{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    by_broadcast = sorted(map(str, mixing.poisson_mix(docs).collect()))
    monkeypatch.setattr(mixing, "SOURCES", -1)
    assert by_broadcast and sorted(map(str, mixing.poisson_mix(docs).collect())) == by_broadcast
