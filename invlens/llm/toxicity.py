"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 3), in numpy.

A word enters the network as its own embedding (frequent words of the sample)
beside the mean of its character n-gram embeddings, so unseen forms of a word
are read by their letters. Windows of ``WINDOW`` words overlap by half and
cover every word of a text; a document's score is that of its worst window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.llm._cols import carried, quoted
from invlens.llm._store import arrow_map
from invlens.llm._text import mix

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 8, 12, 1 << 17
#: Bounds of the sample the network is fitted on: rows of each label, and code points of one text.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
MAX_VOCABULARY = 20_000
THRESHOLD = 0.7
#: Texts at which a feature's log odds count half.
SHRINK = 1.5
#: A word: letters and digits with at least one letter, so that figures in place of letters stay inside it.
_WORDS = re.compile(r"(?=\d*[^\W\d_])[^\W_]+")
_GRAMS = (3, 4, 5)
#: A longer run of letters (a script without spaces, spaces taken out) becomes pieces of this length, overlapping by half.
PIECE = 32
#: Distinct words whose n-grams are held at once while their inputs are added up.
_CHUNK = 4096


def words_of(text: str | None) -> list[str]:
    found = _WORDS.findall((text or "").lower())
    if not any(len(w) > PIECE for w in found):
        return found
    return [piece for w in found for piece in ([w] if len(w) <= PIECE else [w[i:i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)])]


def held_out(doc_id):
    """Rows that no label is learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram of the words, each word between two borders, and the word it is of."""
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(codes == 2) - 1
    buckets, owners = [], []
    for n in _GRAMS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(1_000_003) + codes[i:len(codes) - n + 1 + i]
        inside = word[n - 1:] == word[:len(h)]
        buckets.append((mix(h + np.uint64(n)) & np.uint64(BUCKETS - 1))[inside].astype(np.int32))
        owners.append(word[:len(h)][inside].astype(np.int32))
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW + 1, STRIDE))
    return starts if starts[-1] == n - WINDOW else [*starts, n - WINDOW]


@dataclass
class Network:
    """Parameters by name, and the vocabulary. ``constant`` is the score of all texts if there was nothing to tell apart."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    constant: float | None = None

    def inputs(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for lo in range(0, len(words), _CHUNK):
            some = words[lo:lo + _CHUNK]
            ids = np.array([self.vocabulary.get(w, 0) for w in some], np.int32)
            b, o = gram_rows(some)
            starts = np.searchsorted(o, np.arange(len(some)))
            chars = np.add.reduceat(self.p["chars"][b], starts, axis=0) / np.maximum(np.bincount(o, minlength=len(some)), 1)[:, None].astype(np.float32)
            out[lo:lo + len(some)] = np.concatenate([self.p["words"][ids], chars], axis=1) @ self.p["W"] + self.p["b"]
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Probabilities of windows; ``gates`` is (time, window, 6 HIDDEN), ``mask`` (time, window) is 0 beyond a short text's end."""
        t_max, n, _ = gates.shape
        hs, tape = [], []
        for d in (0, 1):
            U, h = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            out, steps = np.empty((t_max, n, HIDDEN), np.float32), []
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                g = gates[t, :, 3 * HIDDEN * d:3 * HIDDEN * (d + 1)]
                a = h @ U
                zr = _sigmoid(g[:, :2 * HIDDEN] + a[:, :2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
                new = c + z * (h - c)
                if mask is not None:
                    new = np.where(mask[t][:, None], new, h)
                if keep:
                    steps.append((t, h, z, r, c, a[:, 2 * HIDDEN:]))
                out[t] = h = new
            hs.append(out)
            tape.append(steps)
        h = np.concatenate(hs, axis=2)
        u = np.tanh(h @ self.p["A"] + self.p["a"])
        e = u @ self.p["v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        prob = _sigmoid(pooled @ self.p["o"] + self.p["ob"][0])
        return (prob, (h, u, w, pooled, tape)) if keep else prob

    def backward(self, d_logit: np.ndarray, mask, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all parameters above the gates, and of the gates."""
        h, u, w, pooled, tape = kept
        grad = {"o": pooled.T @ d_logit, "ob": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * self.p["o"][None]
        dw = np.einsum("nh,tnh->tn", d_pool, h)
        de = w * (dw - (w * dw).sum(axis=0))
        du = de[:, :, None] * self.p["v"] * (1 - u * u)
        grad["v"] = np.einsum("tn,tnk->k", de, u)
        grad["A"], grad["a"] = np.einsum("tnh,tnk->hk", h, du), du.sum(axis=(0, 1))
        dh_all = w[:, :, None] * d_pool[None] + du @ self.p["A"].T
        d_gates = np.zeros((*w.shape, 6 * HIDDEN), np.float32)
        for d in (0, 1):
            U, dU, carry = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"]), 0.0
            for t, before, z, r, c, ac in reversed(tape[d]):
                dh = dh_all[t, :, HIDDEN * d:HIDDEN * (d + 1)] + carry
                live = mask[t][:, None] if mask is not None else 1.0
                dn, skip = dh * live, dh * (1 - live)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (before - c) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                da = np.concatenate([dz, dr, dc * r], axis=1)
                d_gates[t, :, 3 * HIDDEN * d:3 * HIDDEN * (d + 1)] = np.concatenate([dz, dr, dc], axis=1)
                dU += before.T @ da
                carry = dn * z + da @ U.T + skip
            grad[f"U{d}"] = dU
        return grad, d_gates


def _initial(rng: np.random.Generator, vocabulary: int) -> dict[str, np.ndarray]:
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    dim, k = WORD_DIM + CHAR_DIM, 2 * HIDDEN
    return {"words": f(vocabulary, WORD_DIM, scale=0.1), "chars": f(BUCKETS, CHAR_DIM, scale=0.1), "W": f(dim, 6 * HIDDEN, scale=dim**-0.5), "b": np.zeros(6 * HIDDEN, np.float32), "U0": f(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "U1": f(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "A": f(k, k, scale=k**-0.5), "a": np.zeros(k, np.float32), "v": f(k, scale=0.5), "o": f(k, scale=0.5), "ob": np.zeros(1, np.float32)}


def _log_odds(toxic: np.ndarray, clean: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """Log odds of each feature from the numbers of toxic and clean texts that have it, drawn towards 0 where these are few."""
    raw = np.log((toxic + 0.5) / (rows[1] + 1)) - np.log((clean + 0.5) / (rows[0] + 1))
    return (raw * (toxic + clean) / (toxic + clean + SHRINK)).astype(np.float32)


def _adam(table: np.ndarray, m: np.ndarray, v: np.ndarray, rows, g: np.ndarray, step: int, rate: float = 0.01) -> None:
    """One Adam step on the given rows of a table."""
    m[rows] += 0.1 * (g - m[rows])
    v[rows] += 0.001 * (g * g - v[rows])
    table[rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-8)


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a table, and the sum of the values for each."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    return own[heads], np.add.reduceat(values[order], heads, axis=0)


def fit(sample: list[tuple[str, int]], epochs: int = 8, seed: int = 7) -> Network:
    """Fits the network to labelled texts; only windows carry a loss, and a toxic text's is that of its worst window.

    Words and n-grams start from their log odds in the sample, in the first
    coordinate of their embedding. Each round picks the worst windows of every
    text by the network so far (at first by word log odds): one of each toxic
    text, four of each clean one, and clean ones at random. The result is the mean
    of the parameters after each round of the second half, which is steadier than the last ones alone. With texts of one
    label only there is nothing to tell apart, and every text scores 0.
    """
    rows = (sum(not y for _, y in sample), sum(bool(y) for _, y in sample))
    if not rows[0] or not rows[1]:
        return Network({}, {}, 0.0)
    rng = np.random.default_rng(seed)
    # Every text as numbers of its words; the words themselves are kept once.
    index: dict[str, int] = {}
    texts = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t, _ in sample]
    labels = np.array([bool(y) for _, y in sample])
    distinct = list(index)
    del index
    seen = np.zeros((2, len(distinct)))
    for ids, y in zip(texts, labels, strict=True):
        seen[int(y), np.unique(ids)] += 1
    parts, n_grams = [], np.zeros(len(distinct), np.int32)
    for lo in range(0, len(distinct), _CHUNK):
        b, o = gram_rows(distinct[lo:lo + _CHUNK])
        parts.append(b)
        n_grams[lo:lo + _CHUNK] = np.bincount(o, minlength=len(distinct[lo:lo + _CHUNK]))
    b_all = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    del parts
    cuts = np.concatenate([[0], np.cumsum(n_grams)])
    grams = np.zeros((2, BUCKETS))
    for ids, y in zip(texts, labels, strict=True):
        if len(ids):
            own = np.unique(ids)
            grams[int(y), np.unique(np.concatenate([b_all[cuts[i]:cuts[i + 1]] for i in own.tolist()]))] += 1
    often = np.flatnonzero(seen.sum(axis=0) >= 3)
    often = often[np.lexsort((often, -seen.sum(axis=0)[often]))][:MAX_VOCABULARY - 1]
    vocabulary_of = np.zeros(len(distinct), np.int32)
    vocabulary_of[often] = np.arange(1, len(often) + 1)
    net = Network(_initial(rng, len(often) + 1), {distinct[i]: k for k, i in enumerate(often.tolist(), 1)})
    p = net.p
    p["words"][0] = 0
    word_odds, gram_odds = _log_odds(seen[1], seen[0], rows), _log_odds(grams[1], grams[0], rows)
    p["words"][1:, 0] = word_odds[often] / 2
    met = grams.sum(axis=0) > 0
    p["chars"][met, 0] = np.maximum(-1.0, gram_odds[met])
    odds = word_odds + 2 * np.array([np.sort(gram_odds[b_all[cuts[i]:cuts[i + 1]]])[-3:].mean() if n_grams[i] else 0 for i in range(len(distinct))], np.float32)
    del seen, grams, word_odds, gram_odds, met
    starts = [window_starts(len(ids)) for ids in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
    windows = np.full((len(owner), WINDOW), -1, np.int32)
    score = np.zeros(len(owner), np.float32)
    at = 0
    for ids, begins in zip(texts, starts, strict=True):
        for first in begins:
            w = ids[first:first + WINDOW]
            windows[at, :len(w)] = w
            score[at] = odds[w].max() if len(w) else 0.0
            at += 1
    del texts, odds
    label = labels[owner]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch and epoch % 2 == 0:
            table = net.inputs(distinct)
            score = np.concatenate([net.forward(table[np.maximum(windows[i:i + 2048].T, 0)], windows[i:i + 2048].T >= 0) for i in range(0, len(windows), 2048)])
            del table
        order = np.lexsort((-score, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        pick = order[rank < np.where(label[order] == 1, 1, 4)]
        spare = np.flatnonzero(label == 0)
        pick = np.concatenate([pick, rng.choice(spare, min(len(spare), 4 * rows[0]), replace=False)])
        rng.shuffle(pick)
        for at in range(0, len(pick), 256):
            rows_ = pick[at:at + 256]
            seq, y = windows[rows_].T, label[rows_].astype(np.float32)
            mask = seq >= 0
            used, place = np.unique(np.where(mask, seq, 0), return_inverse=True)
            place = place.reshape(seq.shape)
            ids = vocabulary_of[used]
            b = np.concatenate([b_all[cuts[i]:cuts[i + 1]] for i in used.tolist()])
            o = np.repeat(np.arange(len(used)), n_grams[used])
            weight = (1 / np.maximum(n_grams[used], 1))[o].astype(np.float32)
            chars = np.add.reduceat(p["chars"][b] * weight[:, None], np.concatenate([[0], np.cumsum(n_grams[used])[:-1]]), axis=0)
            x = np.concatenate([p["words"][ids] * (rng.random((len(ids), 1)) > 0.2), chars], axis=1).astype(np.float32)  # at times the letters alone must do
            gates = (x @ p["W"] + p["b"])[place]
            prob, kept = net.forward(gates, mask, keep=True)
            grad, d_gates = net.backward(((prob - y) * np.where(y == 1, 2.0, 1.0) / len(y)).astype(np.float32), mask, kept)
            d_in = np.zeros((len(used), 6 * HIDDEN), np.float32)
            touched, sums = _row_sums(place[mask], d_gates[mask])
            d_in[touched] = sums
            grad["W"], grad["b"] = x.T @ d_in, d_in.sum(axis=0)
            dx = d_in @ p["W"].T
            step += 1
            for k, g in grad.items():
                _adam(p[k], *moments[k], slice(None), g, step)
            known = ids > 0
            if known.any():
                _adam(p["words"], *moments["words"], *_row_sums(ids[known], dx[known, :WORD_DIM]), step)
            _adam(p["chars"], *moments["chars"], *_row_sums(b, dx[o, WORD_DIM:] * weight[:, None]), step)
        if epoch >= epochs // 2:
            for k, v in p.items():
                mean[k] += v / (epochs - epochs // 2)
    return Network(mean, net.vocabulary)


def at_threshold(p: np.ndarray) -> np.ndarray:
    """Probabilities on the scale of the scores: the network decides at 1/2, a score at ``THRESHOLD``, so the logit is shifted by the threshold's."""
    odds = THRESHOLD / (1 - THRESHOLD)
    return p * odds / (p * odds + 1 - p)


class Scorer:
    """Scores texts; keeps the gate inputs of the words met, up to ``limit`` of them."""

    def __init__(self, net: Network, limit: int = 150_000):
        self.net, self.limit = net, limit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 6 * HIDDEN), np.float32)
        self.used = 0

    def _ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            if self.used + len(new) > self.limit and self.used:
                self._reset()
                new = list(dict.fromkeys(words))
            while self.used + len(new) + 1 > len(self.table):
                grown = np.zeros((2 * len(self.table), 6 * HIDDEN), np.float32)  # rows not used yet take no memory
                grown[:self.used] = self.table[:self.used]
                self.table = grown
            self.table[self.used:self.used + len(new)] = self.net.inputs(new)
            self.index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None] | pa.Array, chunk: int = 2048) -> np.ndarray:
        """The greatest window score of each text; a text without words is one empty window. Of an Arrow column few texts are Python strings at a time."""
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        out = np.zeros(len(texts))
        lo = 0
        while lo < len(texts):
            hi, held, lists = lo, 0, []
            while hi < len(texts) and held < 50_000:
                lists.append(words_of(texts[hi].as_py() if isinstance(texts, pa.Array) else texts[hi]))
                held += len(lists[-1])
                hi += 1
            ids = self._ids([w for ws in lists for w in ws])
            first = np.concatenate([[0], np.cumsum([len(ws) for ws in lists])])
            starts = [window_starts(len(ws)) for ws in lists]
            owner = np.repeat(np.arange(len(lists)), [len(s) for s in starts])
            begin = np.concatenate([np.asarray(s) for s in starts]) + first[owner]
            length = np.minimum(first[owner + 1] - first[owner], WINDOW)
            for whole in (True, False):
                pick = np.flatnonzero((length == WINDOW) == whole)
                for i in range(0, len(pick), chunk):
                    rows = pick[i:i + chunk]
                    at = begin[rows] + np.arange(WINDOW)[:, None]
                    mask = None if whole else np.arange(WINDOW)[:, None] < length[rows]
                    seq = ids[at] if whole else np.where(mask, ids[np.minimum(at, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
                    np.maximum.at(out, lo + owner[rows], self.net.forward(self.table[seq], mask))
            lo = hi
        return at_threshold(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """The texts to learn from: of each label the first ``rows`` ids in hash order, of those that are not held out and have a text of up to ``chars`` code points.

    Ids and lengths alone settle which; then at most ``2 rows`` ids are
    broadcast, and one text of each (the least, if rows repeat an id) reaches the driver.
    """
    order = F.xxhash64("doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    known = known.where(~held_out(F.col("doc_id"))).join(texts.select("doc_id"), "doc_id", "left_semi")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(rows).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(rows))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    return [(r["text"], r["toxic"]) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]


def train(docs: DataFrame, labels: DataFrame) -> Network:
    return fit(labelled_sample(docs, labels))


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on); one pass, no shuffle.

    Whole texts are scored; null and empty texts get the score of an empty
    window. Input columns named like an output are replaced.
    """
    extra = carried(docs, ["score", "predicted"], [])
    base = docs.select(*map(quoted, extra))
    at = [c.lower() for c in base.columns].index("text")
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            s = scorer.scores(b.column(at)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    return arrow_map(base, run, StructType([*base.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
