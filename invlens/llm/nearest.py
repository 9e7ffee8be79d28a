"""Nearest vectors by largest inner product, through a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put into the leaf that it
reaches by the nearest centre at each level. A query walks the tree best bin
first: a priority queue holds the nodes not yet opened, by the inner product
that their best member may be expected to have, and leaves are visited in the order in which
they leave the queue. How many is settled by calibration: ``PROBES`` rows are
searched exactly over all rows, the place of each true neighbour's leaf in the probe's
order is noted, and visits are widened until the mean recall reaches the target.
Rows and queries of a leaf then meet in blocks of bounded size.

Bounds: the sample has at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes, the tree at most ``LEAVES`` leaves;
both, and ``PROBES * k`` neighbours, are all that the driver sees.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invlens.llm import _vectors as V
from invlens.llm._store import arrow_map, written

SAMPLE, SAMPLE_BYTES, LEAVES, PROBES, BRANCHES = 65_536, 64 << 20, 4096, 256, 16
_FOUND = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Centres of all nodes (0 is the root), spread of each, children of each (none: a leaf), and the leaf numbers."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level (ties: the first)."""
        node = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            kids = self.children[at]
            if not len(kids) or not len(rows):
                continue
            pick = kids[_nearest(x[rows], self.centres[kids])]
            node[rows] = pick
            todo += [(int(k), rows[pick == k]) for k in kids]
        return self.leaf[node]

    def orders(self, q: np.ndarray, weights: np.ndarray, visits: int, enough: int):
        """Per query its leaves in the order of visits: ``visits`` of them, and more until they hold ``enough`` rows."""
        d = q.shape[1]
        expect = q @ self.centres.T + 3 / math.sqrt(d) * np.linalg.norm(q, axis=1)[:, None] * self.spread
        for row in expect.tolist():
            queue, out, rows = [(-row[0], 0)], [], 0
            while queue and (len(out) < visits or rows < enough):
                _, at = heapq.heappop(queue)
                if self.leaf[at] >= 0:
                    out.append(int(self.leaf[at]))
                    rows += int(weights[self.leaf[at]])
                for k in self.children[at].tolist():
                    heapq.heappush(queue, (-row[k], k))
            yield out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


def fit_tree(sample: np.ndarray, leaves: int, branches: int = BRANCHES, rounds: int = 8, seed: int = 7) -> Tree:
    """Hierarchical k-means: a node with more than its share of the sample is split into up to ``branches`` parts."""
    rng = np.random.default_rng(seed)
    share = max(1, len(sample) // max(1, leaves))
    centres, spread, children, leaf, found = [], [], [], [], 0
    todo = [(np.arange(len(sample)), -1)]
    while todo:
        rows, parent = todo.pop()
        at, x = len(centres), sample[rows]
        centre = x.mean(axis=0) if len(x) else np.zeros(sample.shape[1])
        centres.append(centre)
        spread.append(math.sqrt(((x - centre) ** 2).sum(axis=1).mean()) if len(x) else 0.0)
        children.append([])
        leaf.append(-1)
        if parent >= 0:
            children[parent].append(at)
        k = min(branches, -(-len(rows) // share))
        parts = _kmeans(x, k, rounds, rng) if k > 1 and spread[-1] > 0 else []
        if len(parts) > 1:
            todo += [(rows[p], at) for p in parts]
        else:
            leaf[at], found = found, found + 1
    return Tree(np.array(centres), np.array(spread), [np.array(c, np.int64) for c in children], np.array(leaf))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> list[np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        centres = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    own = _nearest(x, centres)
    return [p for j in range(k) if len(p := np.flatnonzero(own == j))]


def _best(rows: dict, q_ids: np.ndarray, q: np.ndarray, k: int):
    """(query index, row index, score) of each query's k best rows in a block, its own row left out; ties to the smaller id."""
    ids, x = rows["id"], rows["vec"]
    if "by_id" not in rows["cache"]:
        by = np.argsort(ids, kind="stable")
        rows["cache"].update(by_id=by, sorted=ids[by], longest=float(np.linalg.norm(x, axis=1).max()))
    by, in_order = rows["cache"]["by_id"], rows["cache"]["sorted"]
    for part in V.steps(len(q), len(x)):
        s = q[part] @ x.T
        at = np.minimum(np.searchsorted(in_order, q_ids[part]), len(ids) - 1)
        own = np.flatnonzero(in_order[at] == q_ids[part])
        s[own, by[at[own]]] = -np.inf
        if s.shape[1] > k:
            least = np.partition(s, -k, axis=1)[:, -k]
        else:
            least = np.full(len(s), -np.inf)
        slack = 1e-12 * np.linalg.norm(q[part], axis=1) * rows["cache"]["longest"]
        qi, ri = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        score = np.concatenate([V.exact_products(q[part][qi[i:i + 32768]], x[ri[i:i + 32768]]) for i in range(0, max(1, len(qi)), 32768)])
        order = np.lexsort((ids[ri], -score, qi))
        qi, ri, score = qi[order], ri[order], score[order]
        first = np.searchsorted(qi, qi)
        top = np.arange(len(qi)) - first < k
        yield qi[top] + part.start, ri[top], score[top]


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _exact_leaves(index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list:
    """(query_id, leaf) of the true k best rows of a few queries, over all rows."""
    d = q.shape[1]

    def run(batches):
        best: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                rows = {"id": part.column(0).to_numpy(), "vec": V.matrix(part.column(2), d), "cache": {}}
                leaf = part.column(1).to_numpy()
                for qi, ri, s in _best(rows, ids, q, k):
                    best = tuple(np.concatenate(x) for x in zip(best, (qi, rows["id"][ri], s, leaf[ri]), strict=True))
                order = np.lexsort((best[1], -best[2], best[0]))
                best = tuple(x[order] for x in best)
                top = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) < k
                best = tuple(x[top] for x in best)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2]), pa.array(best[3].astype(np.int32))], ["query_id", "vec_id", "score", "leaf"])

    return _top(arrow_map(index.select("id", "leaf", "vec"), run, _FOUND + ", leaf int"), k).select("query_id", "leaf").collect()


def calibrated_visits(tree: Tree, weights: np.ndarray, index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> tuple[int, np.ndarray]:
    """Least number of visits whose mean recall over the probes is ``recall``, and the share of probes that visit each leaf then."""
    orders = dict(zip(ids.tolist(), tree.orders(q, weights, tree.leaves, 0), strict=True))
    place = {i: {leaf: p for p, leaf in enumerate(o)} for i, o in orders.items()}
    at = sorted(place[i][leaf] for i, leaf in _exact_leaves(index, ids, q, k))
    visits = at[max(0, math.ceil(recall * len(at)) - 1)] + 1 if at else tree.leaves
    share = np.bincount([leaf for o in orders.values() for leaf in o[:visits]], minlength=tree.leaves) / max(1, len(ids))
    return visits, share


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row whose id ``every`` divides.

    The query's own row is no candidate; ties go to the smaller id; the score is the
    inner product of the original vectors in doubles. Rows without id, and null,
    zero, incomplete or non-finite vectors, take no part, nor do vectors of
    another length than most have; of rows with one id one takes part. An empty table gives none. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = written(V.packed(V.usable(df, id_col, vec_col)), "vectors")
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = len(rows.select("vec").first()["vec"]) // 8
    leaves = max(8, min(LEAVES, round(math.sqrt(n) / 4)))
    bound = max(1024, min(SAMPLE, 64 * leaves, SAMPLE_BYTES // (8 * d)))
    taken = V.sampled(rows, n, bound).collect()
    sample = V.matrix([bytes(r["vec"]) for r in taken], d)
    tree = fit_tree(sample, leaves)
    probe_ids = np.array([r["id"] for r in taken[:PROBES]], np.int64)

    shared = spark.sparkContext.broadcast(tree)  # at most LEAVES leaves, so under 2 * LEAVES centres

    def assign(batches):
        for b in batches:
            leaf = shared.value.leaf_of(V.matrix(b.column(1), d)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf.astype(np.int32)), b.column(1)], ["id", "leaf", "vec"])

    index = written(arrow_map(rows.select("id", "vec"), assign, "id long, leaf int, vec binary"), "vector-leaves")
    counts = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([counts.get(i, 0) for i in range(tree.leaves)])
    visits, share = calibrated_visits(tree, weights, index, probe_ids, sample[:PROBES], k, recall)

    size = min(V.BLOCK_ROWS, max(256, 2 * n // tree.leaves))
    first, many = V.blocks(counts, tree.leaves, size)
    queries = index.where(F.pmod("id", F.lit(every)) == 0)
    n_queries = n // every + 1
    parts = [max(1, math.ceil(float(share[leaf]) * n_queries / V.ASKS)) for leaf in range(tree.leaves) for _ in range(many[leaf])]
    first_key = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(int).tolist()

    def visit(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                orders = list(shared.value.orders(V.matrix(part.column(1), d), weights, visits, k + 1))
                wanted = [[first[leaf] + j for leaf in o for j in range(many[leaf])] for o in orders]
                take = pa.array(np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]))
                block = np.concatenate([np.array(w, np.int32) for w in wanted])
                yield pa.RecordBatch.from_arrays([pa.array(block), part.column(0).take(take), part.column(1).take(take)], ["block", "id", "vec"])

    def lit(x):
        return F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")

    none = (F.lit(0).cast("long").alias("tag"), F.lit(b"").alias("aux"))
    own_block = (lit(first)[F.col("leaf")] + F.pmod(F.xxhash64("id"), lit(many)[F.col("leaf")])).cast("int")
    candidates = index.select(own_block.alias("block"), "id", "vec", *none)
    asks = arrow_map(queries.select("id", "vec"), visit, "block int, id long, vec binary").select("block", "id", "vec", *none)

    def answer(block, q):
        for qi, ri, s in _best(block, q["id"], q["vec"], k):
            yield pa.RecordBatch.from_arrays([pa.array(q["id"][qi]), pa.array(block["id"][ri]), pa.array(s)], ["query_id", "vec_id", "score"])

    return _top(V.meet(candidates, asks, parts, first_key, answer, _FOUND), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
