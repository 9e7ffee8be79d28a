"""Nearest neighbours, hard negatives and spelling variants against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from invlens.llm import _vectors, hard_negatives, nearest, spelling

from llm_fixtures import HARD, docs, hard, no_docs  # noqa: F401

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"

#: Null, empty, zero, broken and odd vectors, repeats, a null id, a null label, another length.
ODD = [
    (20, None, 1), (40, [], 2), (60, [0.0, 0.0, 0.0], 1), (80, [1.0, None, 0.0], 1), (100, [1.0, NAN, 0.0], 1), (120, [1.0, INF, 0.0], 1),
    (None, [1.0, 0.0, 0.0], 1), (140, [1.0, 0.0], 1), (7, [0.5, 0.5, 0.5], None), (160, [0.125, 0.25, 0.375], 3), (160, [0.125, 0.25, 0.375], 3),
]


def some_vectors(n=700, d=3, copies=200, seed=3):
    """Random vectors, a third near one direction, many exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.2, 3, size=(n, 1))
    x[: n // 3] = x[0] + rng.normal(size=(n // 3, d)) * 0.01
    x[n - copies:] = x[n - copies]
    ids = rng.permutation(4 * n)[:n] + 1000
    return [(int(i), [float(np.float32(y)) for y in v], int(rng.integers(0, 4))) for i, v in zip(ids, x, strict=True)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("id", "vec", "rank", "score", "tag", "query_id", "a.b"):
        df = df.withColumn(c, F.lit("extra"))
    return df


def whole(rows, d, zero):
    kept = {}
    for i, v, t in rows:
        if i is not None and v is not None and len(v) == d and all(y is not None and math.isfinite(y) for y in v) and (zero or any(v)):
            kept.setdefault(i, (v, t))
    return kept


def plain_nearest(rows, d, every, k):
    x = whole(rows, d, zero=False)
    out = {}
    for q in x:
        if q % every == 0:
            s = [(-sum(a * b for a, b in zip(x[q][0], x[c][0], strict=True)), c) for c in x if c != q]
            out[q] = sorted(s)[:k]
    return out


def test_nearest_with_full_recall_equals_brute_force(spark):
    """With all leaves visited the result is exact, ties among copies and odd rows included."""
    rows = some_vectors() + ODD
    want = plain_nearest(rows, 3, 20, 20)
    got = {}
    for r in nearest.nearest_neighbours(frame(spark, rows), recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, len(w) + 1))
        x = whole(rows, 3, False)
        assert all(abs(s - sum(a * b for a, b in zip(x[q][0], x[v][0], strict=True))) < 1e-12 for _, v, s in g)
        assert g == sorted(g, key=lambda t: (-t[2], t[1]))
        hits += len({v for _, v, _ in g} & {c for _, c in w})
    assert hits >= 0.98 * sum(map(len, want.values()))


def test_nearest_recall_on_table(spark):
    """Recall against brute force over the whole table, at the default target."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in nearest.nearest_neighbours(e).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    p = e.toPandas().sort_values("vec_id")
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    hits = total = 0
    for j in np.flatnonzero(ids % 20 == 0):
        s = x @ x[j]
        s[j] = -np.inf
        true = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        assert len(got[ids[j]]) == 20 and ids[j] not in got[ids[j]]
        hits, total = hits + len(true & got[ids[j]]), total + 20
    assert hits / total >= 0.9


def test_nearest_small_tables(spark):
    assert nearest.nearest_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in nearest.nearest_neighbours(frame(spark, ODD)).collect()] == [(160, 1, 7, 0.375)]
    assert nearest.nearest_neighbours(frame(spark, ODD[:6])).collect() == []
    few = [(20, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [-1.0, 0.0], 1)]
    got = [tuple(r) for r in nearest.nearest_neighbours(frame(spark, few)).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]


def test_tree_puts_every_row_into_a_leaf_and_visits_each_once():
    x = np.array([v for _, v, _ in some_vectors()])
    tree = nearest.fit_tree(x, 12)
    leaf = tree.leaf_of(x)
    assert leaf.min() >= 0 and leaf.max() < tree.leaves
    weights = np.bincount(leaf, minlength=tree.leaves)
    for order in tree.orders(x[:20], weights, tree.leaves, 0):
        assert sorted(order) == list(range(tree.leaves))
    for order in tree.orders(x[:20], weights, 1, 400):  # widened until enough rows are in reach
        assert weights[order].sum() >= 400 > weights[order[:-1]].sum()


def plain_negatives(rows, d, every=100):
    x = {i: ([math.floor(256 * y) for y in v], (t + 1) % 10 if i % 7 == 0 else t) for i, (v, t) in whole([r for r in rows if r[2] is not None], d, zero=True).items()}
    out = []
    for a in x:
        if a % every:
            continue
        s = sorted((-sum(p * q for p, q in zip(x[a][0], x[b][0], strict=True)), b) for b in x if b != a)
        same = [(p, b) for p, b in s if x[b][1] == x[a][1]][:5]
        for p, pos in same:
            fit = [(n, b) for n, b in s if x[b][1] != x[a][1] and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, pos, r, b, -p, -n) for r, (n, b) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [65_536, 64])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    """Copies, ties, several blocks of a cell, odd rows and clashing columns."""
    monkeypatch.setattr(_vectors, "BLOCK_ROWS", block)
    rows = some_vectors(n=600, d=3, seed=11) + ODD + [(300, [0.0, 0.0, 0.0], 2), (400, [0.001, 0.002, 0.003], 2), (500, [-1.0, 2.0, 0.5], 0), (600, [300.5, -2.0, 7.0], 1)]
    got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(frame(spark, rows)).collect())
    assert got == plain_negatives(rows, 3) and len(got) > 20


def test_hard_negatives_small_tables(spark):
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mine_hard_negatives(frame(spark, [(100, [1.0, 2.0], 1)])).collect() == []
    assert hard_negatives.mine_hard_negatives(frame(spark, [(100, [1.0, 2.0], None), (101, None, 1)])).collect() == []


def test_intervals_hold_every_score():
    """No score lies outside the bounds of its row or of its cell, for random, equal, opposite and zero vectors."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(400, 6)) * rng.uniform(0, 2, size=(400, 1)))
    x[10:20], x[20:30], x[30] = x[0], -x[0], 0
    refs = hard_negatives.references(x, 8)
    a, norm = hard_negatives.angles(x, refs)
    a = a * hard_negatives._STEP
    for i in range(0, 60):
        s = x @ x[i]
        lo, hi = hard_negatives.interval(a[i], norm[i], a, a, norm, norm)
        assert (lo <= s).all() and (s <= hi).all()
        lo, hi = hard_negatives.interval(a[i], norm[i], a.min(axis=0)[None], a.max(axis=0)[None], norm.min()[None], norm.max()[None])
        assert lo[0] <= s.min() and s.max() <= hi[0]


def test_integer_scores_beyond_doubles():
    a, x = np.array([2.0 ** 30 + 1, 1.0]), np.array([[2.0 ** 30 + 3, 5.0]])
    assert hard_negatives.integer_scores(a, x).tolist() == [(2 ** 30 + 1) * (2 ** 30 + 3) + 5]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    c = plain_words(rows)
    near = {w: [v for v in c if one_edit(w, v)] for w in c}
    form = {}
    for w in c:
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        form[w] = best if best and c[best] >= 10 * c[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), c[w], len(near[w]), c[form[w]] if form[w] else None) for w in c}


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()}


def test_spelling_hard_rows(spark, hard, no_docs):
    assert variants(hard) == plain_variants(HARD)
    assert variants(no_docs) == {}


def test_spelling_made_words(spark):
    """Chains of forms, words of one letter, umlauts, edits at both ends, ties, and a third of all words in one family."""
    rng = random.Random(9)
    text = []
    for base, n in (("anticipation", 2000), ("anticipatiom", 150), ("anticipatio", 12), ("nticipatio", 2), ("Überraschung", 300), ("überraschung", 25), ("aaaaaaaa", 40), ("aaaaaaa", 4), ("aaaaaaaab", 4)):
        text += [base] * n
    for _ in range(700):
        w = list("permissible")
        for _ in range(rng.choice([1, 1, 2])):
            k = rng.randrange(len(w))
            w[k:k + rng.randrange(2)] = rng.choice(["", "e", "z", "é"])
        text += ["".join(w)] * rng.choice([2, 2, 3, 40])
    text += ["".join(rng.choice("abc") for _ in range(rng.choice([7, 8]))) for _ in range(4000)]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i * 100:(i + 1) * 100])) for i in range(len(text) // 100 + 1)]
    got = variants(spark.createDataFrame(rows, "doc_id long, text string"))
    want = plain_variants(rows)
    assert got == want
    assert sum(bool(v[0]) for v in want.values()) > 50 and any(v[0] and v[1] != v[0] for v in want.values())


def test_spelling_pivots_are_disjoint_prefix_bigrams(spark):
    words = ["abcdefg", "aaaaaaa", "zzyzzyzz", "überfluß", "x" * 5000]
    for r in spelling.indexed(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect():
        places = {x.p for x in r.prefix}
        assert {r.p1, r.p2} <= places and r.p1 + 2 <= r.p2 and len(places) >= min(spelling.PREFIX, r.len - 1)
