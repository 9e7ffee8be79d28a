"""Hard negatives by angles: triangle intervals of the score decide which rows are scored at all.

Vectors become integers, floor(256 * x). A bounded sample gives reference
directions; every row stores its angle to each (16 bits) and lies in the cell of the nearest.
For an anchor a and a row x the angle between them is at least the greatest
difference, and at most the least sum, of their angles to one reference; the cosines
of that interval times both norms bound the score, widened by more than all rounding. The same holds for a whole
cell from its least and greatest angles and norms. A cell is opened for an anchor
only if its interval meets what is searched, and inside it only rows whose own
interval does get their integer product.

First the positives: what is searched are scores from the fifth best of the anchor's
label in the sample upwards, since the fifth best of all rows is not below. Then the
negatives: windows from 80 to 100 % of each positive's score. The driver sees the
sample (``SAMPLE`` rows at most) and one line per cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invlens.llm import _vectors as V
from invlens.llm._store import arrow_map, shuffle_parts, written

SAMPLE, SAMPLE_BYTES, REFERENCES, PROBES, SCALE = 4096, 32 << 20, 64, 256, 256.0
#: A stored angle is a whole number of these steps; two of them are more than storing and arc cosine can be off.
_STEP = math.pi / 65_535
_SLACK = 2 * _STEP


def references(sample: np.ndarray, m: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Unit directions from a spherical k-means over the sample's nonzero rows."""
    norm = np.linalg.norm(sample, axis=1)
    x = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return np.eye(1, sample.shape[1])
    m = min(m, len(x))
    refs = x[np.random.default_rng(seed).choice(len(x), m, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ refs.T, axis=1)
        sums = np.array([x[own == j].sum(axis=0) for j in range(m)])
        size = np.linalg.norm(sums, axis=1)
        refs = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], refs)
    return refs


def angles(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each row to each reference in steps, and the norms. A zero row has angle 0 and norm 0."""
    norm = np.linalg.norm(x, axis=1)
    cos = (x @ refs.T) / np.where(norm > 0, norm, 1)[:, None]
    a = np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0)
    return np.rint(a / _STEP).astype(np.uint16), norm


def interval(theta: np.ndarray, norm: float, least: np.ndarray, most: np.ndarray, n_least: np.ndarray, n_most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of an anchor's scores with rows (or cells) whose angles lie in [least, most], norms in [n_least, n_most]."""
    near = np.maximum(least - theta, theta - most).max(axis=1) - _SLACK
    far = np.minimum((theta + most).min(axis=1), (2 * math.pi - theta - least).min(axis=1)) + _SLACK
    hi, lo = np.cos(np.clip(near, 0, math.pi)), np.cos(np.clip(far, 0, math.pi))
    room = 1e-6 * norm * n_most + 1e-6
    return norm * lo * np.where(lo >= 0, n_least, n_most) - room, norm * hi * np.where(hi >= 0, n_most, n_least) + room


def integer_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles while these hold every sum, else in Python's integers."""
    if not len(x):
        return np.zeros(0, np.int64)
    if len(a) * float(np.abs(a).max()) * float(np.abs(x).max()) < 2.0 ** 53:
        return (x @ a).astype(np.int64)
    return np.array([sum(int(p) * int(q) for p, q in zip(a, r, strict=True)) for r in x], object).astype(np.int64)


def _cells(index: DataFrame, m: int) -> list:
    """Per cell: rows, least and greatest angle to each reference, least and greatest norm. At most one line per reference returns."""
    schema = "cell int, n long, least binary, most binary, n_least double, n_most double"

    def merged(found: dict, cell, n, least, most, a, b):
        if cell in found:
            o = found[cell]
            found[cell] = (o[0] + n, np.minimum(o[1], least), np.maximum(o[2], most), min(o[3], a), max(o[4], b))
        else:
            found[cell] = (n, least, most, a, b)

    def out(found):
        if found:
            c, rest = list(found), list(zip(*found.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(rest[0], pa.int64()), *(pa.array([x.tobytes() for x in r], pa.binary()) for r in rest[1:3]), *(pa.array(r, pa.float64()) for r in rest[3:])], ["cell", "n", "least", "most", "n_least", "n_most"])

    def partial(batches):
        found: dict = {}
        for b in batches:
            cell, norm = b.column(0).to_numpy(), b.column(1).to_numpy()
            a = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(b.num_rows, m)
            for c in np.unique(cell).tolist():
                own = cell == c
                merged(found, c, int(own.sum()), a[own].min(axis=0), a[own].max(axis=0), float(norm[own].min()), float(norm[own].max()))
        yield from out(found)

    def total(batches):
        found: dict = {}
        for b in batches:
            for c, n, lo, hi, p, q in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                merged(found, c, n, np.frombuffer(lo, np.uint16), np.frombuffer(hi, np.uint16), p, q)
        yield from out(found)

    parts = arrow_map(index.select("cell", "norm", "angles"), partial, schema)
    return arrow_map(parts.repartition(shuffle_parts(index.sparkSession), "cell"), total, schema).collect()


def _meets(lo: np.ndarray, hi: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether [lo, hi] meets one of the windows (rows of least, greatest)."""
    out = np.zeros(len(lo), bool)
    for a, b in windows:
        out |= (hi >= a) & (lo <= b)
    return out


def _windows(scores: list[int], low: int, high: int) -> np.ndarray:
    """Bounds of the negatives' scores for each positive's score; a negative score has no window."""
    return np.array([[low * p / 100, high * p / 100] for p in scores if p >= 0], float).reshape(-1, 2)


def mine_hard_negatives(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, relabel: int = 7, classes: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but rank.

    Anchors are the rows whose id ``every`` divides; where ``relabel`` divides the id the
    label first becomes (label + 1) % ``classes``. Rows without id or label, with a
    null vector or a null or non-finite component take no part, nor do vectors
    of another length than most have; of rows with one id one takes part. Zero
    vectors do take part. Scores are integers and tie to the smaller id. A positive of
    negative score has no negatives. Empty tables give none; other columns are ignored.
    """
    spark = df.sparkSession
    labelled = df.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("tag"), F.col(vec_col).alias("v"))
    usable = V.usable(labelled, "id", "v", ["tag"], zero=True)
    usable = usable.withColumn("tag", F.when(F.pmod("id", F.lit(relabel)) == 0, (F.col("tag") + 1) % classes).otherwise(F.col("tag")))
    rows = written(V.packed(usable, SCALE), "integer-vectors")
    n = rows.count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], result)
    d = len(rows.select("vec").first()["vec"]) // 8
    taken = V.sampled(rows, n, max(256, min(SAMPLE, SAMPLE_BYTES // (8 * d)))).collect()
    sample = V.matrix([bytes(r["vec"]) for r in taken], d)
    refs = references(sample, max(4, min(REFERENCES, round(math.sqrt(n) / 8))))
    m = len(refs)

    def assign(batches):
        for b in batches:
            x = V.matrix(b.column(2), d) if b.num_rows else np.zeros((0, d))
            a, norm = angles(x, refs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(a.argmin(axis=1).astype(np.int32) if len(a) else [], pa.int32()), pa.array(norm), pa.array([r.tobytes() for r in a], pa.binary())], ["id", "tag", "vec", "cell", "norm", "angles"])

    index = written(arrow_map(rows.select("id", "tag", "vec"), assign, "id long, tag long, vec binary, cell int, norm double, angles binary"), "vector-angles")
    cells = _cells(index, m)
    known = [c["cell"] for c in cells]
    least, most = (np.array([np.frombuffer(c[x], np.uint16) for c in cells], float) * _STEP for x in ("least", "most"))
    n_least, n_most = (np.array([c[x] for c in cells]) for x in ("n_least", "n_most"))
    sample_ids, sample_tags = np.array([r["id"] for r in taken]), np.array([r["tag"] for r in taken])

    size = min(V.BLOCK_ROWS, max(256, 2 * n // m))
    first, many = V.blocks({c["cell"]: c["n"] for c in cells}, m, size)
    n_anchors = n // every + 1

    def positives_from(anchor: int, tag: int, x: np.ndarray) -> np.ndarray:
        """Where the positives' scores begin: the fifth best score of the label in the sample, if there are so many."""
        own = (sample_tags == tag) & (sample_ids != anchor)
        if own.sum() < positives:
            return np.array([[-np.inf, np.inf]])
        return np.array([[np.sort(integer_scores(x, sample[own]))[-positives], np.inf]])

    def opened(x: np.ndarray, windows: np.ndarray) -> list[int]:
        a, norm = angles(x[None, :], refs)
        return [known[i] for i in np.flatnonzero(_meets(*interval(a[0] * _STEP, norm[0], least, most, n_least, n_most), windows))]

    def put(anchors: DataFrame, window_of) -> DataFrame:
        """The anchors (id, tag, vec, aux) with each block that they open; the windows go along as aux."""

        def run(batches):
            for b in batches:
                blocks, at, aux = [], [], []
                for i, (row, tag, more) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 3)), strict=True)):
                    x = V.matrix(b.column(2).slice(i, 1), d)[0]
                    windows = window_of(row, tag, x, more)
                    for c in opened(x, windows):
                        blocks += range(first[c], first[c] + many[c])
                        at += [i] * many[c]
                        aux += [windows.tobytes() if more is None else more] * many[c]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(aux, pa.binary())], ["block", "id", "tag", "vec", "aux"])

        return arrow_map(anchors, run, "block int, id long, tag long, vec binary, aux binary")

    def lit(x):
        return F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")

    own_block = (lit(first)[F.col("cell")] + F.pmod(F.xxhash64("id"), lit(many)[F.col("cell")])).cast("int")
    candidates = index.select(own_block.alias("block"), "id", "tag", "vec", F.col("angles").alias("aux"))
    probes = [opened(x, positives_from(i, t, x)) for i, t, x in zip(sample_ids[:PROBES].tolist(), sample_tags[:PROBES].tolist(), sample[:PROBES], strict=True)]
    share = np.bincount([c for o in probes for c in o], minlength=m) / len(probes)  # of the anchors that open a cell; it only deals out work
    parts = [max(1, math.ceil(float(share[c]) * n_anchors / V.ASKS)) for c in range(m) for _ in range(many[c])]
    first_key = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(int).tolist()

    def ready(block):
        if "norm" not in block["cache"]:
            block["cache"].update(angles=np.frombuffer(b"".join(block["aux"]), np.uint16).reshape(len(block["aux"]), m) * np.float64(_STEP), norm=np.linalg.norm(block["vec"], axis=1))
        return block["cache"]["angles"], block["cache"]["norm"]

    def scored(block, x, mask, windows, nth=0):
        """Rows of ``mask`` whose interval meets a window, and their scores; with ``nth`` only those not surely below the nth best."""
        a, norm = ready(block)
        at = np.flatnonzero(mask)
        if not len(at):
            return at, np.zeros(0, np.int64)
        own, size_ = angles(x[None, :], refs)
        lo, hi = interval(own[0] * _STEP, size_[0], a[at], a[at], norm[at], norm[at])
        if nth and len(at) > nth:
            windows = np.array([[max(windows[0][0], np.partition(lo, -nth)[-nth]), np.inf]])
        at = at[_meets(lo, hi, windows)]
        return at, integer_scores(x, block["vec"][at])

    def answer_positive(block, q):
        out = [[], [], []]
        for i, tag, x, aux in zip(q["id"], q["tag"], q["vec"], q["aux"], strict=True):
            at, s = scored(block, x, (block["tag"] == tag) & (block["id"] != i), np.frombuffer(aux).reshape(-1, 2), positives)
            top = np.lexsort((block["id"][at], -s))[:positives]
            out[0] += [i] * len(top)
            out[1] += block["id"][at[top]].tolist()
            out[2] += s[top].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score"])

    def answer_negative(block, q):
        out = [[], [], [], [], []]
        for i, tag, x, aux in zip(q["id"], q["tag"], q["vec"], q["aux"], strict=True):
            wanted = np.frombuffer(aux, np.int64).reshape(-1, 2)
            at, s = scored(block, x, block["tag"] != tag, _windows(wanted[:, 1].tolist(), low, high))
            if not len(at):
                continue
            order = np.lexsort((block["id"][at], -s))
            at, s = at[order], s[order]
            scores = s.tolist()
            for p_id, p in wanted.tolist():
                from_ = int(np.searchsorted(-s, -(high * p // 100), "left"))
                top = [j for j in range(from_, min(len(scores), from_ + negatives)) if low * p <= 100 * scores[j] <= high * p]
                for j in top:
                    for c, value in zip(out, (i, p_id, p, int(block["id"][at[j]]), scores[j]), strict=True):
                        c.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    anchors = index.where(F.pmod("id", F.lit(every)) == 0).select("id", "tag", "vec")
    asks = put(anchors.withColumn("aux", F.lit(None).cast("binary")), lambda i, tag, x, _: positives_from(i, tag, x))
    found = V.meet(candidates, asks, parts, first_key, answer_positive, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = written(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives).select("anchor_id", "positive_id", "positive_score"), "positives")

    few = found.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))

    def as_bytes(batches):
        for b in batches:
            aux = [np.array([[r["positive_id"], r["positive_score"]] for r in p], np.int64).tobytes() for p in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(aux, pa.binary())], ["id", "tag", "vec", "aux"])

    again = arrow_map(anchors.join(few, "id").select("id", "tag", "vec", "p"), as_bytes, "id long, tag long, vec binary, aux binary")
    asks = put(again, lambda i, tag, x, aux: _windows(np.frombuffer(aux, np.int64).reshape(-1, 2)[:, 1].tolist(), low, high))
    found = V.meet(candidates, asks, parts, first_key, answer_negative, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
