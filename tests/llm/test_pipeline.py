"""The pipeline, stage by stage, against plain Python over a small corpus with planted cases."""

from __future__ import annotations

import hashlib
import math
import re

import corpus_pipeline
import numpy as np
from test_queries_llm import brute_dedup

from tidegauge.llm import decontaminate, suffix_dedup
from tidegauge.llm import shingles as shingles_module
from tidegauge.llm import simhash as simhash_module
from tidegauge.llm.simhash import simhash

VOWELS, HARD = "aeiou", "bcdfglmnprst"


def prose(draw, n):
    word = lambda: "".join(draw.choice(list(HARD)) + draw.choice(list(VOWELS)) for _ in range(draw.integers(1, 4)))
    return [word() for _ in range(n)]


def groups(texts):
    """doc_id -> the smallest doc_id reachable over links of Jaccard similarity 0.8 or more on five-word shingles."""

    def shingles(t):
        ws = (t or "").lower().split()
        return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}

    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    links = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_stages_match_plain_python(spark, tmp_path):
    draw = np.random.default_rng(11)
    base = [prose(draw, int(n)) for n in draw.integers(80, 160, 60)]
    passage = " ".join(prose(draw, 70))
    item = prose(draw, 40)
    texts = {k: " ".join(ws) for k, ws in enumerate(base)}
    texts[100] = texts[3]  # an exact copy
    texts[101] = " ".join([*base[4][:-1], "endings"])  # a near copy
    for k in (5, 6, 7):
        texts[k] += " é " + passage
    texts[8] += " " + " ".join(item[:20] + ["oddly"] + item[21:])
    texts[102] = "zxq vvkw qqj xzzt wvq kkq zzx qvx jjw " * 6  # like no language
    texts[103] = "12 34 56"
    rows = [(d, t, None if d in (102, 103) else "en", "big" if d % 4 else "rare", len(t)) for d, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(texts)
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, docs: corpus_pipeline.written(stages[name](spark, docs, str(tmp_path)))
    now = lambda docs: {r.doc_id: r.text for r in docs.collect()}

    docs = step("language", docs)
    left = {d: t for d, t in left.items() if d not in (102, 103)}
    assert now(docs) == left

    docs = step("near_duplicate", docs)
    root = groups(left)
    left = {d: t for d, t in left.items() if root[d] == d}
    assert now(docs) == left and 100 not in left and 101 not in left and len(left) == 60

    docs = step("repeated_passages", docs)
    cut = {}
    for d, (raw, off) in brute_dedup(left.items()).items():
        wide, at = [], 0
        for c in raw.decode():
            n = len(c.encode())
            wide.append("" if off[at : at + n].any() else c)
            at += n
        cut[d] = "".join(wide)
    assert now(docs) == cut and passage in cut[5] and passage not in cut[6] + cut[7]
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = step("decontaminated", docs)
    cut.pop(8)
    assert now(docs) == cut

    source = {d: s for d, _, _, s, _ in rows}
    sizes = {s: sum(source[d] == s for d in cut) for s in ("big", "rare")}
    want = []
    for d in cut:
        u, rate, k = int(hashlib.md5(f"7:{d}:{cut[d]}".encode()).hexdigest()[:13], 16) / 2**52, 0.5 * len(cut) / sizes[source[d]], 0
        p = total = math.exp(-rate)
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want += [(d, r + 1) for r in range(k)]
    mixed = step("mixed", docs)
    assert sorted((r.doc_id, r.replica) for r in mixed.collect()) == sorted(want)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.replica, r.text) for r in whole.collect()) == sorted((r.doc_id, r.replica, r.text) for r in mixed.collect())


def test_near_duplicates_are_those_of_true_similarity(spark, monkeypatch):
    draw = np.random.default_rng(17)
    texts = {0: "one two three", 1: "One  two three", 2: None, 3: " ", 4: "one two"}
    footer = " ".join(prose(draw, 30))  # common shingles, in short texts most of them
    for _ in range(40):
        ws, at = prose(draw, int(draw.integers(20, 90))), len(texts)
        texts[at] = " ".join(ws) + (" " + footer if at % 3 else "")
        for edits in (1, 1, 2, 3, 4):
            new = list(ws)
            for k in draw.choice(len(ws), edits, replace=False):
                new[k] = "edited" + str(len(texts))
            texts[len(texts)] = " ".join(new) + (" " + footer if at % 3 else "")

    root = groups(texts)
    far = [d for d in texts if root[d] != d and ((simhash(texts[d], 5) ^ simhash(texts[root[d]], 5)) & (2**64 - 1)).bit_count() > 4]
    assert len(far) > 5
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for common, paired in ((8, 64), (0, 1)):  # the second links nearly all through pivots
        monkeypatch.setattr(shingles_module, "COMMON", common)
        monkeypatch.setattr(shingles_module, "PAIRED", paired)
        kept = corpus_pipeline.near_duplicate(spark, docs, "").collect()
        assert sorted(r.doc_id for r in kept) == sorted(d for d in texts if root[d] == d)


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, clashing columns, and an empty table."""
    draw = np.random.default_rng(4)
    text = [" ".join(prose(draw, 60)) for _ in range(14)]
    item = " ".join(prose(draw, 20))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, kept string, hashes string, none string, tests string"
    tail = (0.5, "r", "k", "h", "n", "t")
    rows = [(k, t, "en", "web", len(t), *tail) for k, t in enumerate(text[:10])]
    rows += [rows[1], (1, text[10], "en", None, None, *tail), (None, text[11], None, "web", 1, *tail), (None, text[12], None, "web", 1, *tail), (None, text[2], "en", "web", 1, *tail)]
    rows += [(20, None, None, None, None, *[None] * 6), (21, "", "en", "web", 0, *tail), (22, " \n", "en", "web", 2, *tail), (2, text[13] + " " + item, "en", "web", 9, *tail)]
    spark.createDataFrame([("a", item), (None, item), ("b", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: corpus_pipeline.written(stages[name](spark, df, str(tmp_path)))
    bag = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    want = lambda keep: sorted((str(r[0]), str(r[1])) for r in rows if keep(r))
    lettered = lambda r: bool((r[1] or "").strip())
    out = {name: step(name, docs) for name in stages}
    assert bag(out["language"]) == want(lettered)
    # of the texts without words the smallest id stays; the copy without an id goes
    assert bag(out["near_duplicate"]) == want(lambda r: (lettered(r) or r[0] == 20) and not (r[0] is None and r[1] == text[2]))
    assert bag(out["repeated_passages"]) == want(lambda r: True)  # only equal ids and null ids repeat each other
    assert bag(out["decontaminated"]) == want(lambda r: not (r[1] or "").endswith(item))
    assert {"rate", "copies", "replica", "shuffle_key"} <= set(out.pop("mixed").columns)
    for df in out.values():
        assert df.columns == docs.columns and [f.dataType for f in df.schema] == [f.dataType for f in docs.schema]
    assert all(stage(spark, docs.where("false"), str(tmp_path)).isEmpty() for stage in stages.values())


def test_sets_of_pairs_are_chosen_without_moving_the_others(spark, monkeypatch):
    plans, plain = [], shingles_module.written
    monkeypatch.setattr(shingles_module, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    sets = spark.createDataFrame([(k, bytes([k % 50]), bytes([k % 50] * 8)) for k in range(60)], "k long, key binary, hashes binary")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 55)], "a long, b long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = shingles_module._of_pairs(sets, pairs).collect()
        monkeypatch.setattr(shingles_module, "SENT", 1)
        joined = shingles_module._of_pairs(sets, pairs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1] and "SortMergeJoin" in plans[3]
    assert sorted(r.key[0] for r in sent) == sorted(r.key[0] for r in joined) == [1, 2, 3, 5]


def test_only_sets_of_likely_pairs_are_stored(spark, monkeypatch):
    draw, stored, plain = np.random.default_rng(23), [], shingles_module.written

    def written(df):
        out = plain(df)
        stored.extend(r.hashes for r in out.select("hashes").collect()) if "hashes" in out.columns else None
        return out

    monkeypatch.setattr(shingles_module, "written", written)
    texts = {k: " ".join(prose(draw, 90)) for k in range(40)}
    texts |= {40: texts[7] + " more", 41: texts[9]}
    kept = corpus_pipeline.near_duplicate(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert {len(bytes(h)) for h in stored} == {86 * 8, 87 * 8} and len(set(map(bytes, stored))) == 2


def test_sets_of_one_frequent_shingle_are_held_against_each_other_by_sketches(spark, monkeypatch):
    draw, counts, plain = np.random.default_rng(29), [], shingles_module._verified
    monkeypatch.setattr(shingles_module, "_verified", lambda pairs, *rest: counts.append(pairs.count()) or plain(pairs, *rest))
    for name, value in (("SAMPLE", 1), ("PAIRED", 4)):
        monkeypatch.setattr(shingles_module, name, value)
    base = prose(draw, 60)
    texts = {at: " ".join([*base[:at], f"edited{at}", *base[at + 1 :]]) for at in range(4, 56, 2)}  # two of them have a similarity of 0.78 at most
    texts[99] = texts[30] + " more"
    kept = corpus_pipeline.near_duplicate(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(texts)[:-1]
    assert counts[-1] <= 40  # of 325 pairs


def test_components_are_made_again_only_for_new_links(spark, monkeypatch):
    draw, calls, plain = np.random.default_rng(29), [], shingles_module.components
    monkeypatch.setattr(shingles_module, "components", lambda edges: calls.append(1) or plain(edges))
    for name, value in (("SAMPLE", 1), ("PAIRED", 4)):
        monkeypatch.setattr(shingles_module, name, value)
    base = prose(draw, 60)
    texts = {at: " ".join([*base[:at], f"edited{at}", *base[at + 1 :]]) for at in range(4, 56, 2)}  # two of them have a similarity of 0.78 at most
    texts[99] = texts[30]
    kept = corpus_pipeline.near_duplicate(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(texts)[:-1]
    assert len(calls) == 1


def test_rows_made_of_fewer_are_never_broadcast(spark, monkeypatch):
    draw, plans = np.random.default_rng(31), []
    for module in (decontaminate, shingles_module, simhash_module, suffix_dedup):
        monkeypatch.setattr(module, "written", lambda df, plain=module.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    base = [prose(draw, 60) for _ in range(20)]
    texts = [" ".join(p[:k] + ["edited"] + p[k:]) for p in base for k in (0, 60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:3]])), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(base[0][:30]))], "item_id long, text string")
    made = [simhash_module.near_duplicates(docs), corpus_pipeline.near_duplicate(spark, docs, ""), suffix_dedup.dedup_substrings(docs), decontaminate.contaminated(docs, items)]
    assert [df.count() for df in made] == [43, 20, 43, 4]
    sent = re.findall(r"BroadcastHashJoin \[(\w+)#.*?\], \[(\w+)#.*?\], Inner", "".join(plans))
    joined = re.findall(r"SortMergeJoin \[(\w+)#.*?\], \[(\w+)#.*?\], Inner", "".join(plans))
    made_of_fewer = {("part", "part"), ("h", "h"), ("digest", "digest"), ("c1", "c1")}
    assert not made_of_fewer & set(sent) and made_of_fewer <= set(joined)


def test_sketches_rule_out_no_pair_of_the_similarity():
    draw = np.random.default_rng(31)
    ruled = 0
    for _ in range(600):
        n, least = int(draw.integers(1, 1500)), shingles_module.Fraction("0.8")
        x = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(draw.integers(0, n // 4 + 1))
        y = np.unique(np.concatenate([x[gone:], draw.integers(0, 2**64, int(draw.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        a, b = shingles_module.sketch(x), shingles_module.sketch(y)
        both, words = len(np.intersect1d(x, y)), min(len(a), len(b))
        differ = int(np.bitwise_count(shingles_module.folded(a, words) ^ shingles_module.folded(b, words)).sum())
        assert differ <= len(x) + len(y) - 2 * both
        fits = shingles_module.possible(a, b, len(x) + len(y), least)
        assert fits or both * 10 < 8 * (len(x) + len(y) - both)
        ruled += not fits
    assert ruled > 50
