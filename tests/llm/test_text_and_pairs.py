"""Operators on texts against plain-Python versions: winnowing, licence scan, substring dedup, Jaccard join, decontamination."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from invlens.llm import decontamination, jaccard_join, licenses, sketch, substring_dedup, winnowing
from invlens.llm._text import SPACE_WORD, grams, groups, lower, mix, shingle_sets, sliding_min, word_hashes, words
from invlens.llm.components import components

from llm_fixtures import HARD, docs, hard, no_docs  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile("[^\x20\x09-\x0d]+")


def plain_winnow(text, k, w):
    c = [ord(x) for x in text]
    if not c:
        return [], []
    k = min(k, len(c))
    w = min(w, len(c) - k + 1)
    m, base = 1 << 64, winnowing._BASE
    h = mix(np.array([(sum((c[i + j] + 1) * pow(base, j, m) for j in range(k)) + k) % m for i in range(len(c) - k + 1)], np.uint64)).tolist()
    at = sorted({max(p for p in range(i, i + w) if h[p] == min(h[i:i + w])) for i in range(len(h) - w + 1)})
    return [h[p] for p in at], at


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé中😀 ", max_size=120), st.integers(1, 6), st.integers(1, 20))
def test_winnow_equals_plain(text, k, w):
    h, p = winnowing.winnow(text, k, w)
    assert (h.tolist(), p.tolist()) == plain_winnow(text, k, w)


def test_winnow_in_steps_equals_whole(monkeypatch):
    text = "".join(random.Random(3).choice("abc") for _ in range(900))
    whole = winnowing.winnow(text, 5, 9)
    monkeypatch.setattr(winnowing, "_STEP", 64)
    parts = winnowing.winnow(text, 5, 9)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_winnow_guarantee():
    """Texts that share k + w - 1 code points share a fingerprint of that stretch."""
    rng = random.Random(5)
    k, w = 8, 10
    for _ in range(50):
        common = "".join(rng.choice("abcdefg") for _ in range(k + w - 1))
        a = "".join(rng.choice("uvwxyz") for _ in range(40)) + common
        b = common + "".join(rng.choice("mnopq") for _ in range(40))
        assert set(winnowing.winnow(a, k, w)[0].tolist()) & set(winnowing.winnow(b, k, w)[0].tolist())


def test_near_edited_of_short_texts(spark, docs):
    """Texts of 20 to 150 code points are not all or nothing: two thirds of the text stay, so its likeness is neither 0 nor that of another text."""
    source = sorted(r["text"] for r in docs.where("length(text) >= 150").select("text").limit(40).collect())
    texts = [t[:n] for n in range(20, 151, 2) for t in source[n % 7::7]]
    rows = winnowing.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    near = {n: [r["near_edited"] for r in rows if r["n_chars"] == n] for n in {r["n_chars"] for r in rows}}
    # 22 code points keep 15 = k + w - 1, which always match; 20 keep 14 and nearly always do
    assert all(x > 0 for n, xs in near.items() if n >= 22 for x in xs)
    assert np.mean([x > 0 for n, xs in near.items() if n < 22 for x in xs]) > 0.5
    assert all(len(r["positions"]) > 1 for r in rows if r["n_chars"] >= 60)


def test_compare_with_next(spark, docs, hard, no_docs):
    for df in (docs, hard, no_docs, hard.where("doc_id = 0")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1]] + [1]))
        want = []
        for i, (d, text) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            edited = winnowing.edited_text(text, following)
            own, other, nxt = (winnowing.winnow(t)[0] for t in (text, edited, following))
            want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.as_text(own), winnowing.as_text(other), winnowing.likeness(own, other), winnowing.likeness(own, nxt)))
        got = [tuple(r)[:7] for r in winnowing.compare_with_next(df).collect()]
        assert Counter(got) == Counter(want)


def test_licenses_against_plain_search(docs, hard, no_docs):
    phrases = [(p.split(), label, base) for t, base in ((licenses.BASE_PHRASES, True), (licenses.PHRASES, False)) for p, label in t.items()]
    for df in (docs, hard, no_docs):
        got = Counter(tuple(r) for r in licenses.scan_licenses(df).collect())
        want = Counter()
        for d, text in df.select("doc_id", "text").collect():
            ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
            found = [(len(p), label, base, [i for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]) for p, label, base in phrases]
            found = [f for f in found if f[3]]
            places = [i for f in found if f[2] for i in f[3]]
            n = max((f[0] for f in found), default=0)
            want[(d, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({f[1] for f in found if f[2]})), ",".join(sorted({f[1] for f in found})), n / (n + 2) if n else 0.0)] += 1
        assert got == want


ISC_OLD = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."""
POSTGRES = "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."
CDDL = "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."
GPL3 = "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def plain_templates(text):
    """Labels of ``TEMPLATES`` by a search of every key phrase at every word."""
    ws = (text or "").translate(LOWER)
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ws)
    out = set()
    for label, (words, keys) in licenses.TEMPLATES.items():
        t, keys = words.split(), [k.split() for k in keys]
        at = lambda where, k: [i for i in range(len(where) - len(k) + 1) if where[i:i + len(k)] == k]
        gaps = [at(t, k)[0] - at(t, keys[0])[0] for k in keys]
        if any(all(any(abs(b - a - g) <= licenses.DRIFT for b in at(ws, k)) for k, g in zip(keys, gaps, strict=True)) for a in at(ws, keys[0])):
            out.add(label)
    return out


def test_license_templates(spark):
    drift = licenses.DRIFT
    both = lambda n: "common development and distribution license " + "x " * n + "you may not use this file except in compliance with the license"
    rows = [
        (1, ISC_OLD), (2, "// " + ZLIB.replace("\n", "\n// ")), (3, POSTGRES), (4, CDDL), (5, GPL3), (6, GPL3.replace("version 3", "version 2")),
        (7, ZLIB.replace("Altered source", "Changed source")), (8, POSTGRES.replace("two", "three")), (9, both(2 + drift)), (10, both(3 + drift)),
        (11, ISC_OLD + " filler" * 50 + " " + ZLIB), (12, ZLIB + " " + ZLIB), (13, None), (14, ""), (16, "M\u0130T License, m\u0130t license; mar\u212aed\x00MIT\x7fLICENSE"), (17, ZLIB.replace("marked", "mar\u212aed")), (None, CDDL), (4, CDDL),
        (15, "you may not use this file except in compliance with the license common development and distribution license"),
        *[(100 + i, words) for i, (words, _) in enumerate(licenses.TEMPLATES.values())], (200, "fee origin versions altered " * 5000 + CDDL),
    ]
    df = spark.createDataFrame([(d, t, "mine") for d, t in rows], "doc_id long, text string, labels string")
    got = Counter((r["doc_id"], frozenset(r["labels"].split(",")) & set(licenses.TEMPLATES) - set(licenses.PHRASES.values())) for r in licenses.scan_licenses(df).collect())
    own = set(licenses.TEMPLATES) - set(licenses.PHRASES.values())
    assert got == Counter((d, frozenset(plain_templates(t) & own)) for d, t in rows)
    by_id = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan_licenses(df).collect()}
    assert [sorted(by_id[i]) for i in (1, 2, 3, 4)] == [["ISC"], ["Zlib"], ["PostgreSQL"], ["CDDL-1.0"]]
    assert "GPL-3.0-or-later" in by_id[5] and "GPL-2.0-or-later" in by_id[6] and "gpl" in by_id[6]
    assert by_id[7] == by_id[8] == by_id[10] == by_id[13] == by_id[17] == {""} and by_id[9] == {"CDDL-1.0"} and by_id[11] == {"ISC", "Zlib"}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in by_id[100 + i]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(d, t) for d, t in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = Counter(con.sql(licenses.scan_sql()).fetchall())
    assert Counter(tuple(r) for r in licenses.scan_licenses(df).collect()) == want


def test_licenses_is_native(docs):
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_dedup(rows, size):
    own = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, ws in split:
        for i in range(len(ws) - size + 1):
            if d is not None:
                k = tuple(ws[i:i + size])
                own[k] = min(own.get(k, d), d)
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - size + 1):
            if d is not None and own[tuple(ws[i:i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("size", [50, 7])
def test_substring_dedup_equals_plain(docs, hard, no_docs, size):
    for df in (docs, hard, no_docs):
        got = substring_dedup.remove_repeated_windows(df, size)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == plain_dedup(df.select("doc_id", "text").collect(), size)


def test_substring_dedup_spreads_a_key_of_many_windows(spark, monkeypatch):
    """A passage of 80 words with other text around it in every document: no task gets all windows of its key."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    rows = [(d, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(60)), *passage, *(f"z{rng.randrange(10**6)}" for _ in range(60))])) for d in range(500)]
    rows += [(d + 1000, t) for d, t in rows[:40]] + [(3, rows[3][1]), (None, rows[3][1])]
    most, plain = [], substring_dedup._owners

    def owners(classes):
        most.append(classes.groupBy("key").agg(F.sum(F.octet_length("windows") / 6).alias("n")).agg(F.max("n")).first()[0] or 0)
        return plain(classes)

    monkeypatch.setattr(substring_dedup, "_owners", owners)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.remove_repeated_windows(df)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == plain_dedup(df.collect(), 50)
    assert most[0] <= 4096


@pytest.mark.parametrize("size", [50, 7])
def test_substring_dedup_with_every_key_hot(docs, hard, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", 1)
    test_substring_dedup_equals_plain(docs, hard, hard.limit(0), size)


def test_substring_dedup_keeps_other_columns(hard):
    out = substring_dedup.remove_repeated_windows(hard)
    assert out.columns == ["doc_id", "text", "score", "component_id", "key", "rank", "n_words", "n_removed", "kept_text"]


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3000, 5000)
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(7)

    def hashes(batches):
        for b in batches:
            yield mix(b.column(0).to_numpy().view(np.uint64))

    cells = 1 << 20
    bits = sketch.repeated(sketch.partial(df, hashes, cells), cells)
    every = np.arange(3000)
    flagged = sketch.maybe_repeated(bits, mix(every.astype(np.uint64)))
    counts = np.bincount(values, minlength=3000)
    assert flagged[counts >= 2].all() and flagged[counts < 2].mean() < 0.05


def plain_components(rows, percent=80):
    sets, out = [], {}
    for d, t in rows:
        ws = SPACE.findall((t or "").translate(LOWER))
        sets.append((d, set(zip(*[ws[j:] for j in range(5)], strict=False)) if len(ws) >= 5 else ({tuple(ws)} if ws else set())))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


def near_copies(n, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n // 10):
        base = [f"{c}w{i}" for i in range(120)]
        for _ in range(10):
            ws = list(base)
            for _ in range(rng.randint(0, 5)):
                ws[rng.randrange(len(ws))] = f"e{rng.random()}"
            out.append(" ".join([*ws, *(f"common{i}" for i in range(rng.choice([0, 0, 20])))]))
    return [(i, t) for i, t in enumerate(rng.sample(out, len(out)))]


def test_jaccard_equals_plain(spark, hard, no_docs):
    chains = spark.createDataFrame(near_copies(120, 2), "doc_id long, text string").repartition(5)
    for df in (chains, hard, no_docs):
        got = Counter(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
        assert got == plain_components(df.select("doc_id", "text").collect())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 250), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[300] == got[250] == 200


def plain_contained(docs, items):
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    out = Counter()
    for d, t in docs:
        ws = cut(t)
        for i, x in items:
            q = cut(x)
            k = min(5, len(q))
            if not k:
                continue
            a, b = set(zip(*[q[j:] for j in range(k)], strict=False)), set(zip(*[ws[j:] for j in range(k)], strict=False))
            if 100 * len(a & b) >= 80 * len(a):
                out[(d, i, len(a), len(a & b))] += 1
    return out


@pytest.mark.parametrize("limit", [decontamination.BLOCK_SHINGLES, 60])
def test_decontamination_equals_plain(spark, docs, hard, no_docs, limit, monkeypatch):
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (limit,))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "short"), (1003, "two three"), (1004, HARD[8][1]), (1004, HARD[8][1]), (None, "one two three four five six")], "item_id long, text string")
    items = bench.union(odd)
    for df in (docs, hard, no_docs):
        got = Counter(tuple(r)[:4] for r in decontamination.contained_items(df, items).collect())
        want = plain_contained(df.select("doc_id", "text").collect(), items.collect())
        assert got == want
        kept = decontamination.without_contaminated(df, items)
        bad = {t for d, t in df.select("doc_id", "text").collect() if plain_contained([(0, t)], items.collect())}
        assert kept.columns == df.columns
        assert Counter(kept.select("text").collect()) == Counter(r for r in df.select("text").collect() if r[0] not in bad)
    assert decontamination.contained_items(docs, bench.where("false")).count() == 0


def test_shingles_match_words():
    import pyarrow as pa

    texts = ["A b  c d e f a b c d e", "", None, "x", "é É ü a b c d"]
    for t, s in zip(texts, shingle_sets(pa.array(texts), 5, SPACE_WORD), strict=True):
        ws = SPACE.findall((t or "").translate(LOWER))
        assert len(s) == (len(set(zip(*[ws[j:] for j in range(5)], strict=False))) if len(ws) >= 5 else min(1, len(ws)))
    assert sliding_min(np.array([5, 3, 4, 1, 9]), 3).tolist() == [3, 1, 1]


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    seen = defaultdict(set)
    for texts in (["aa bb aa", "bb cc"], ["cc aa", "", "bb"]):
        for _, _, data, offs in groups(pa.array(texts)):
            s, e, first = words(lower(data), offs, SPACE_WORD)
            for a, b, h in zip(s, e, word_hashes(data, s, e, segment=2), strict=True):
                seen[data[a:b].tobytes()].add(int(h))
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == 3
    assert len(grams(np.arange(4, dtype=np.uint64), 5)) == 0


def test_hard_rows_are_all_there(hard):
    assert hard.count() == len(HARD) and hard.where(F.col("doc_id").isNull()).count() == 2


def skewed_texts(variants=150, around=300):
    """Variants of one text of 60 words, each with some words of its own, and texts around a passage that they share."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(variants):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            w[rng.randrange(60)] = f"v{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(30)]
    for i in range(variants, variants + around):
        own = [f"o{rng.randrange(3000)}" for _ in range(rng.choice([8, 30, 60]))]
        cut = rng.randrange(len(own))
        rows.append((i, " ".join(own[:cut] + passage + own[cut:])))
    return rows


def test_merged_sketch_takes_few_jobs(spark):
    """A merged sketch comes back in a few jobs, not one for each shuffle partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.sparkContext.setJobGroup("merged-sketch", "test")
    try:
        items = spark.range(3000).selectExpr("xxhash64(id % 2000) AS h")
        bits = sketch.repeated(sketch.partial(items, lambda bs: (b.column(0).to_numpy().view(np.uint64) for b in bs), 1 << 20), 1 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("merged-sketch")) <= 15
    hashes = np.array([r[0] for r in spark.range(2000).selectExpr("xxhash64(id)").collect()], np.int64).view(np.uint64)
    hit = sketch.maybe_repeated(bits, hashes)
    assert hit[:1000].all() and hit[1000:].sum() < 20


def test_jaccard_passes_hold_few_sets(monkeypatch):
    """Both passes over the texts make the shingle sets of a few hundred rows at a time, also of a large batch."""
    taken, seen, sets = [], [], jaccard_join.X.shingle_sets
    monkeypatch.setattr(jaccard_join, "arrow_map", lambda df, run, schema: taken.append(run))
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: df)
    monkeypatch.setattr(jaccard_join.X, "shingle_sets", lambda col, *a, **k: seen.append(len(col)) or sets(col, *a, **k))

    class Sent:
        value = np.zeros(1 << 17, np.uint8)

    jaccard_join._sizes(None, 5, 1 << 20)
    jaccard_join._prefixes(None, Sent, 5, 80)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([f"a b c d e {i}" for i in range(3000)])], ["doc_id", "text"])
    for run in taken:
        out = [i for b in run(iter([batch])) for i in b.column(0).to_pylist() if i is not None]
        assert out == list(range(3000))
    assert sum(seen) == 6000 and max(seen) <= 512


def test_jaccard_shuffles_only_rows_with_copies(spark, tmp_path, monkeypatch):
    """A text without copies goes from the second pass to the classes as it is; copies and repeated rows go through the join; the classes are the same."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(400)] + [(900, "same text of six words here"), (901, "same text of six words here"), (5, "same text of six words here"), (902, ""), (903, None), (904, "short"), (904, "short")]
    kept, written = {}, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: kept.setdefault(name, written(df, name)) if name != "links" else written(df, name))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect())[(901, 2, 5)] == 1
    classes = kept["prefixes"]
    assert {r[0] for r in classes.where("alone").select("a").collect()} >= set(range(400)) - {5}
    assert sorted(r[0] for r in kept["copied-prefixes"].select("a").collect()) == [5, 904, 904]


def test_jaccard_bounds_large_sets_by_longer_bitmaps(spark):
    """Sets of more tokens than the short bitmap has bits fill it and say nothing; unlike ones are parted by the longer one, near ones stay."""
    some = np.random.default_rng(1).integers(0, 1 << 63, 9000, dtype=np.uint64)
    sets = {1: some[:6000], 2: some[100:6000], 3: some[3000:9000]}
    assert jaccard_join._wide(sets[1], 1).size > jaccard_join.BITMAP
    full = {a: jaccard_join._bitmap(s, jaccard_join.BITMAP).tolist() for a, s in sets.items()}
    maps = [(a, len(s), full[a], jaccard_join._wide(s, 1).tolist()) for a, s in sets.items()]
    kinds = "a long, n long, bits array<long>, longer array<long>"
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    bounded = lambda rows: {tuple(r) for r in jaccard_join._bounded(pairs, spark.createDataFrame(rows, kinds), 80).collect()}
    assert bounded(maps) == {(2, 1)}
    assert bounded([(a, n, bits, None) for a, n, bits, _ in maps]) == {(2, 1), (3, 1), (3, 2)}


def test_jaccard_groups_sent_or_shuffled(spark, monkeypatch):
    """Few groups go to the token rows by broadcast, many by a shuffle; the rows are the same."""
    rows = spark.createDataFrame([(t, a, 9) for t in range(4) for a in range(t, 12)], "token long, a long, n long")
    groups = spark.createDataFrame([(a, 3) for a in range(3, 12)], "a long, g long")
    sent = Counter(map(tuple, jaccard_join._grouped(rows, groups).select("token", "a", "n", "g", "held").collect()))
    monkeypatch.setattr(jaccard_join, "SENT_GROUPS", 2)
    assert sent == Counter(map(tuple, jaccard_join._grouped(rows, groups).select("token", "a", "n", "g", "held").collect()))
    assert sent == Counter((t, a, 9, 3 if a >= 3 else a, 12 - t) for t in range(3) for a in range(t, 12))


def test_sketch_cells_and_counts_pack():
    for x in ([0], [0, 0, 5], [262143], [1, 1, 2, 2, 70000, 262143]):
        assert sketch._unpacked(sketch._packed(np.array(x, np.uint32))).tolist() == x
    dense = np.sort(np.random.default_rng(2).integers(0, 1 << 18, 20000).astype(np.uint32))
    assert len(sketch._packed(dense)) < 2 * len(dense)  # four bytes each before
    counts = np.zeros(1 << jaccard_join._BLOCK, np.uint8)
    counts[::7], counts[5] = 1, 255
    assert (jaccard_join._counts_unpacked(jaccard_join._counts_packed(counts)) == counts).all()


def test_jaccard_matrix_in_parts(spark, monkeypatch):
    """The classes of a frequent token ask in several parts, dealt over the tasks; the pairs are the same."""
    bits = [[(1 << (i % 7)) | 1, *[0] * (jaccard_join.BITMAP - 1)] for i in range(400)]
    rows = spark.createDataFrame([(t, i, 3 + i % 2, i // 2, 400) for t in (1, 2) for i in range(400)], "token long, a long, n long, g long, held long")
    classes = spark.createDataFrame([(i, 3 + i % 2, [i * 31 % 17], bits[i]) for i in range(400)], "a long, n long, prefix array<long>, bits array<long>")
    got = []
    for askers in (1 << 10, 50):
        monkeypatch.setattr(jaccard_join, "ASKERS", askers)
        got.append({tuple(r) for r in jaccard_join._matrix_pairs(rows, classes, 80).collect()})
    want = set()
    for a in range(400):
        for b in range(a):
            na, nb, one, two = 3 + a % 2, 3 + b % 2, bits[a][0], bits[b][0]
            most = min(na - (one & ~two).bit_count(), nb - (two & ~one).bit_count())
            if a // 2 != b // 2 and 100 * min(na, nb) >= 80 * max(na, nb) and 180 * most >= 80 * (na + nb):
                want.add((a, b))
    assert want and got[1] == got[0] and got[0] <= want and {p for p in want if p[0] % 2 == p[1] % 2} <= got[0]


def test_jaccard_matrix_stays_small_on_skew(spark):
    """Classes that share tokens without linking: right components, and matrix joins that put out few rows, not the square of a token's classes."""
    rows = skewed_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = {d: c for d, _, c in plain_components(rows)}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, cells=1 << 20).collect()} == want

    # the matrix over classes none of which is grouped yet: every token row is its own group
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for _, t in rows]
    tokens = defaultdict(list)
    for i, s in enumerate(sets):
        for t in sorted(hash(x) & ((1 << 62) - 1) for x in s)[:len(s) - math.ceil(0.8 * len(s)) + 1]:
            tokens[t].append(i)
    held = [(t, i, len(sets[i]), i, len(ids)) for t, ids in tokens.items() if len(ids) > 1 for i in ids]
    maps = []
    for i, s in enumerate(sets):
        m = np.zeros(64 * jaccard_join.BITMAP, np.uint8)
        m[[(hash(x) & ((1 << 62) - 1)) % len(m) for x in s]] = 1
        maps.append((i, len(s), [hash(x) & ((1 << 62) - 1) for x in sorted(s)[:3]], np.packbits(m).view(np.int64).tolist()))
    placed = spark.createDataFrame(held, "token long, a long, n long, g long, held long")
    classes = spark.createDataFrame(maps, "a long, n long, prefix array<long>, bits array<long>")
    pairs = jaccard_join._matrix_pairs(placed, classes, 80)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    linked = {(j, i) for ids in tokens.values() for i in ids for j in ids if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked <= got
    todo, joined = [pairs._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if kind.endswith("JoinExec"):
                joined.append(node.metrics().apply("numOutputRows").value())
    square = sum(len(ids) ** 2 for ids in tokens.values())
    assert max(joined) < square / 4
