"""Benchmark items found inside documents by size-partitioned MinHash containment (operator 10).

An item is contained when at least ``percent`` of its distinct k-word shingles
occur in the document. Items are partitioned by the size of their shingle set,
and the MinHash signature of a partition holds its items' m least hashes, where
``m = u - ceil(percent u / 100) + 1`` for the partition's greatest size u. A
document that contains an item lacks at most m - 1 of its shingles, so at
least one of any m of them, and thus of its signature, is in the document: no
contained item is missed. Every hit is verified by exact shingle containment.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from invlens.llm import _text as X
from invlens.llm._store import arrow_map

SHINGLE, PERCENT = 5, 80
#: Shingles of one block of items, at most (an item is never cut): bounds what is broadcast to 16 MB or one item.
BLOCK_SHINGLES = 1_000_000
SCHEMA = "doc_id long, item_id long, item_shingles long, shared long, containment double"


@dataclass(frozen=True)
class Index:
    """A block of items, sorted by signature hash: hash and item of each entry; and each item's id, word count of its shingles, and sorted shingles."""

    hashes: np.ndarray
    items: np.ndarray
    ids: list
    widths: np.ndarray
    sets: list


def signature_size(n: int, percent: int) -> int:
    """Signature length of the partition of sets of n shingles: partitions hold sizes from a power of two to below the next."""
    u = (1 << n.bit_length()) - 1
    return min(n, u - -(-percent * u // 100) + 1)


def build_index(rows: list[tuple[int | None, str | None]], k: int, percent: int) -> Index:
    """Items of fewer than k words are one shingle of all their words; items without words are left out, as nothing contains them."""
    hashes, items, ids, widths, sets = [], [], [], [], []
    texts = pa.array([t for _, t in rows], pa.string())
    n_words = []
    for _, _, data, offs in X.groups(texts):
        n_words += np.diff(X.words(data, offs, X.ALNUM_WORD)[2]).tolist()
    for (item_id, _), width, s in zip(rows, n_words, X.shingle_sets(texts, k, X.ALNUM_WORD), strict=True):
        if len(s):
            m = signature_size(len(s), percent)
            hashes.append(s[:m])
            items.append(np.full(len(s[:m]), len(ids)))
            ids.append(item_id)
            widths.append(min(width, k))
            sets.append(s)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    i = np.concatenate(items) if items else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    return Index(h[order], i[order], ids, np.array(widths, np.int64), sets)


def blocks(benchmark: DataFrame, k: int, percent: int, limit: int = BLOCK_SHINGLES):
    """Indexes of blocks of items, read one partition at a time; together they hold all items."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "") // 4 + 1
        if size >= limit:
            yield build_index(rows, k, percent)
            rows, size = [], 0
    if rows:
        yield build_index(rows, k, percent)


def find(col: pa.Array, ix: Index, k: int, percent: int, weak: bool = True):
    """(row, item, shared) for every text of a column and every item of the index that it contains.

    Without ``weak`` an item of fewer than ``k`` words counts only where the text has no other words.
    """
    if not len(ix.hashes):
        return
    short = sorted({int(w) for w in ix.widths if w < k})
    for lo, _, data, offs in X.groups(col):
        data = X.lower(data)
        starts, ends, first = X.words(data, offs, X.ALNUM_WORD)
        words = X.word_hashes(data, starts, ends)
        hits, every = defaultdict(set), {}
        for width in [*short, k]:
            g = every[width] = X.grams(words, width)
            at = np.searchsorted(ix.hashes, g)
            found = np.flatnonzero(ix.hashes[np.minimum(at, len(ix.hashes) - 1)] == g)
            doc = np.searchsorted(first, found, "right") - 1
            inside = found + width <= first[doc + 1]
            for j, d in zip(at[found[inside]].tolist(), doc[inside].tolist(), strict=True):
                hits[d].add(j)
        for d, entries in sorted(hits.items()):
            a, z = int(first[d]), int(first[d + 1])
            items = set()
            for j in entries:
                items.update(ix.items[j:np.searchsorted(ix.hashes, ix.hashes[j], "right")].tolist())
            own: dict[int, np.ndarray] = {}
            for i in sorted(items):
                w = int(ix.widths[i])
                if w < k and not weak and z - a != w:
                    continue
                if w not in own:
                    own[w] = np.unique(every[w][a:max(a, z - w + 1)])
                shared = len(np.intersect1d(own[w], ix.sets[i], assume_unique=True))
                if 100 * shared >= percent * len(ix.sets[i]):
                    yield lo + d, i, shared


def _search(docs: DataFrame, index: Index, k: int, percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = sent.value
        for b in batches:
            if out := [(row, ix.ids[i], len(ix.sets[i]), shared, shared / len(ix.sets[i])) for row, i, shared in find(b.column(1), ix, k, percent)]:
                row, *rest = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], ["doc_id", "item_id", "item_shingles", "shared", "containment"])

    return arrow_map(docs, run, SCHEMA)


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): every document and benchmark item that it contains.

    Words are runs of digits, letters and all non-ASCII characters, A-Z
    lower-cased. Texts are read once per block of items and never shuffled.
    Null and empty texts contain nothing; repeated rows give repeated results;
    extra columns are ignored.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    out = None
    for index in blocks(benchmark, k, percent):
        found = _search(texts, index, k, percent)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns kept; nothing is shuffled.

    A few words stand in many clean texts ("yes", a name), so an item under ``k`` words takes out only a text that is it as
    a whole; :func:`contained_items` reports all.
    """
    for index in blocks(benchmark, k, percent):
        docs = _without(docs, index, k, percent)
    return docs


def _without(docs: DataFrame, index: Index, k: int, percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            keep = np.ones(len(b), bool)
            keep[[row for row, _, _ in find(b.column(at), sent.value, k, percent, weak=False)]] = False
            yield b.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)
