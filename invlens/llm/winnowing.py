"""Document fingerprints by winnowing (operator 1).

Every k consecutive code points are hashed by a rolling polynomial. Of each
window of w consecutive hashes the least is chosen, the rightmost among equal
ones, and kept with its position. Two texts that share a stretch of at least
``k + w - 1`` code points (15 with ``K`` and ``W``) share a fingerprint of that
stretch; matches of fewer than k code points are never seen. ``K`` and ``W`` are
small so that short texts have several fingerprints: the first two thirds of a
text of 22 code points or more always match its edited text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.llm._order import BLOCK, with_blocks
from invlens.llm._store import arrow_map
from invlens.llm._text import _powers, list_array, mix, sliding_min

K, W = 8, 8
_BASE = 0xC2B2AE3D27D4EB4F
_STEP = 1 << 18


def _rightmost(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the rightmost least value of some window of w values, ascending."""
    least = sliding_min(h, w)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    reach = ~sliding_min(~padded, w)  # the greatest minimum of the windows that hold a position
    at = np.flatnonzero(h == reach)
    if len(at) > 1:  # only equal values in one window need the exact search
        v = h[at]
        order = np.argsort(v, kind="stable")
        same = (v[order][1:] == v[order][:-1]) & (at[order][1:] - at[order][:-1] < w)
        if same.any():
            index, span = np.arange(len(h)), 1
            while span < w:
                step = min(span, w - span)
                a, b = index[:-step], index[step:]
                index = np.where(h[b] <= h[a], b, a)
                span += step
            return np.unique(index)
    return at


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint64, positions in code points), in order of position.

    A text of fewer than k code points has one hash, that of all of it, at
    position 0; one of fewer than w k-grams has the least of them; an empty or
    null text has none. Long texts are worked through in steps, so the memory
    beside the text is bounded.
    """
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = min(k, len(codes))
    w = min(w, len(codes) - k + 1)
    out_h, out_p, done = [], [], -1
    power, inverse = _powers(_BASE, min(len(codes), _STEP + k + w) + 1)
    for lo in range(0, len(codes) - k - w + 2, _STEP):
        part = codes[lo:lo + _STEP + k + w - 2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=sums[1:])
        n = len(part) - k + 1
        h = mix((sums[k:] - sums[:n]) * inverse[:n] + np.uint64(k))
        at = _rightmost(h, w)
        at = at[at + lo > done]
        if len(at):
            done = int(at[-1]) + lo
            out_h.append(h[at])
            out_p.append(at + lo)
    return np.concatenate(out_h), np.concatenate(out_p)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray) -> str:
    """The upper 32 bits of each hash as eight hexadecimal digits, in order of position."""
    return (hashes >> np.uint64(32)).astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per row: doc_id, n_chars, hashes array<long>, positions array<int>. Null texts count as empty; extra columns are ignored."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [winnow(t, k, w) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), list_array([h for h, _ in found]), list_array([p for _, p in found], np.int32)], ["doc_id", "n_chars", "hashes", "positions"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, hashes array<long>, positions array<int>")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"


def edited_text(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by as many of the following text's first, or all it has."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def compare_with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other and with the next document's.

    Documents stand in descending doc_id order (rows without one last, equal
    ids in the order of their texts); the first follows the last. Texts are
    shuffled once, into ranges of doc_id that are sorted; the first document of
    each range is also sent to the end of the range before it. A worker holds
    two documents at a time. One document alone is its own next one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frame, n = with_blocks(base, "doc_id")
    # The head of a range: its greatest id and, among equal ids, its greatest text. One short row per range reaches the driver.
    tops = {r[BLOCK]: r["top"] for r in frame.groupBy(BLOCK).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    before = {order[i]: order[i - 1] for i in range(len(order))}  # the last range goes before the first
    heads = None
    if order:
        of = F.create_map(*[F.lit(x) for b in order for x in (b, before[b])])
        wanted = F.array(*[F.lit(tops[b]).cast("long") for b in order if tops[b] is not None]) if any(v is not None for v in tops.values()) else None
        is_top = (F.array_contains(wanted, F.col("doc_id")) if wanted is not None else F.lit(False)) | F.col("doc_id").isNull()
        best = frame.where(F.coalesce(is_top, F.lit(True))).groupBy(BLOCK).agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "text", "doc_id")).alias("r"))
        heads = best.select(F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), of[F.col(BLOCK)].alias(BLOCK), F.lit(True).alias("tail"))
    rows = frame.select("doc_id", "text", BLOCK, F.lit(False).alias("tail"))
    rows = rows.unionByName(heads) if heads is not None else rows
    dealt = rows.repartitionByRange(n + 1, BLOCK).sortWithinPartitions(BLOCK, "tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches):
        held = None  # (block, doc_id, text, hashes, positions) of the row that waits for its next one
        for b in batches:
            out = []
            for doc_id, text, block, tail in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", BLOCK, "tail")), strict=True):
                h, p = winnow(text, k, w)
                if held and held[0] == block:
                    _, own_id, own, own_h, own_p = held
                    edited = edited_text(own, text)
                    eh, _ = winnow(edited, k, w)
                    out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_text(own_h), as_text(eh), likeness(own_h, eh), likeness(own_h, h), own_p))
                held = None if tail else (block, doc_id, text, h, p)
            if out:
                *plain, places = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, kinds, strict=True)), list_array(list(places), np.int32)], [x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(dealt, run, SCHEMA)
