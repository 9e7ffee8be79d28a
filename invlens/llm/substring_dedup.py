"""Exact removal of repeated 50-word windows, behind a count-min prefilter (operator 4).

1. Every window of ``size`` words gets a key: the least hash of the shorter
   word groups inside it. Neighbouring windows mostly share their key, and
   equal windows always do. Each task sketches the keys of its windows, once
   per run of equal keys; the merged sketch overestimates how often a key, and
   so any window with that key, occurs.
2. A second pass sends only windows whose key is estimated repeated. They are
   grouped exactly by key and content, the smallest doc_id of each content is
   found, and words that a window of a larger doc_id covers are removed.
3. A key with many windows (a passage that stands in many documents with
   different text around it) is not worked through by one task: its windows
   are spread over the tasks by their content, with a map-side minimum.

No repeated window is lost: its key is met at least twice, and the sketch
never underestimates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invlens.llm import _text as X
from invlens.llm import sketch
from invlens.llm._cols import carried, quoted
from invlens.llm._store import arrow_map, shuffle_parts, written

SIZE = 50
OUTPUTS = ["n_words", "n_removed", "kept_text"]
#: Bytes that stand for a window's words beside its key: a 64-bit hash and part of a second, independent one. Among 10^9
#: windows of one hot key two different ones are taken for equal with a chance under 10^-6.
WIDTH = 10
#: Windows of one row that is sent, at most; longer runs of one key (texts of one repeated word) are cut.
_RUN = 64
#: Windows of one key that one task works through, at most, as long as the keys above it number ``HOT_KEYS`` at most.
HOT_WINDOWS, HOT_KEYS = 4096, 1 << 20


def _runs(hashes: np.ndarray, first: np.ndarray, size: int):
    """Keys of all windows, cut into runs of one key within one document: window hashes, run starts, run ends, key and document of each run."""
    n = len(hashes) - size + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64), none
    part = size // 2
    key = X.sliding_min(X.grams(hashes, part), size - part + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    valid = np.arange(n) + size <= first[1:][doc]
    head = np.ones(n, bool)
    head[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    head &= valid
    starts = np.flatnonzero(head)
    ends = np.minimum(np.append(starts[1:], n), first[1:][doc[starts]] - size + 1)
    return None, starts, ends, key[starts], doc[starts]


def _words_of(data, offs):
    starts, ends, first = X.words(data, offs, X.SPACE_WORD)
    return X.word_hashes(data, starts, ends), first


def _estimated(docs: DataFrame, size: int) -> list[np.ndarray]:
    """The merged sketch of the keys of all windows, as bits of the cells met twice or more."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = sketch.cells_for(int(chars) // 6 * 2 // (size // 2 + 2))

    def keys(batches):
        for b in batches:
            for _, _, data, offs in X.groups(b.column(0)):
                yield _runs(*_words_of(data, offs), size)[3]

    return sketch.repeated(sketch.partial(docs.select("text"), keys, cells), cells)


def _candidates(docs: DataFrame, bits, size: int) -> DataFrame:
    """Runs of windows whose key is estimated repeated: ``WIDTH`` bytes of content hash per window, beside the 64-bit key."""

    def run(batches):
        flags = bits.value
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, data, offs in X.groups(b.column(2)):
                hashes, first = _words_of(data, offs)
                _, starts, ends, key, doc = _runs(hashes, first, size)
                hit = np.flatnonzero(sketch.maybe_repeated(flags, key))
                if not len(hit):
                    continue
                second = X.grams(X.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), size)
                short = np.concatenate([x.view(np.uint8).reshape(-1, 8) for x in (X.grams(hashes, size), second)], axis=1)[:, :WIDTH]
                rows = []
                for i in hit.tolist():
                    for at in range(int(starts[i]), int(ends[i]), _RUN):
                        stop = min(at + _RUN, int(ends[i]))
                        rows.append((lo + int(doc[i]), key[i], at - int(first[doc[i]]), short[at:stop].tobytes()))
                r, k, s, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(r)]), pa.array(keys[list(r)]), pa.array(np.array(k, np.uint64).view(np.int64)), pa.array(s, pa.int64()), pa.array(w, pa.binary())], ["doc_id", "text_key", "key", "start", "windows"])

    found = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    out = arrow_map(found, run, "doc_id long, text_key long, key long, start long, windows binary")
    return out.withColumn("content", F.xxhash64("windows"))


def _owners(classes: DataFrame) -> DataFrame:
    """Per (key, content): stretches of windows and the smallest doc_id that has each.

    Classes arrive by key and then by their smallest doc_id, so the first class
    with a window owns it. Memory: the distinct windows of one key, which is
    not a hot one.
    """

    kind = pa.list_(pa.struct([("owner", pa.int64()), ("offset", pa.int32()), ("count", pa.int32())]))

    def run(batches):
        at, owner = None, {}
        for b in batches:
            keys, contents, found = [], [], []
            for key, content, low, high, windows in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "content", "low", "high", "windows")), strict=True):
                if key != at:
                    at, owner = key, {}
                own = [owner.setdefault(windows[i:i + WIDTH], low) for i in range(0, len(windows), WIDTH)]
                cut = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
                if stretches := [{"owner": own[a], "offset": a, "count": z - a} for a, z in zip(cut, cut[1:], strict=False) if own[a] < high]:
                    keys.append(key)
                    contents.append(content)
                    found.append(stretches)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.array(found, kind)], ["key", "content", "stretches"])

    dealt = classes.repartition(shuffle_parts(classes.sparkSession), "key").sortWithinPartitions("key", "low", "content")
    return arrow_map(dealt, run, "key long, content long, stretches array<struct<owner: long, offset: int, count: int>>")


def _hot_keys(found: DataFrame) -> DataFrame:
    """Keys with too many distinct windows for one task. All windows together bound their number, so they can be broadcast."""
    n = F.octet_length("windows") / WIDTH
    weighed = found.select("key", "content", n.alias("n")).distinct().groupBy("key").agg(F.sum("n").alias("n"))
    total = found.agg(F.sum(n)).first()[0] or 0
    return weighed.where(F.col("n") > max(HOT_WINDOWS, int(total) // HOT_KEYS)).select("key")


def _hot_stretches(found: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, from, to) of the windows of hot keys, each of which goes to a task by its own content.

    Equal runs are merged first. The least and greatest doc_id of a window are
    found with a map-side aggregate, so each window has one owner and its join
    to the runs makes no more rows than the runs have windows. Both sides of
    that join are plain shuffles, of which a large partition can be split. The
    windows of a run that have one owner are the bits of one number.
    """
    classes = written(found.groupBy("key", "content").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("windows").alias("windows")), "hot-classes")
    i = F.explode(F.sequence(F.lit(0), (F.octet_length("windows") / WIDTH).cast("int") - 1))
    each = classes.select("key", "content", "low", "high", "windows", i.alias("i")).withColumn("window", F.expr(f"substring(windows, i * {WIDTH} + 1, {WIDTH})")).drop("windows")
    owned = each.groupBy("key", "window").agg(F.min("low").alias("owner"), F.max("high").alias("last")).where("owner < last").drop("last")
    hit = each.join(written(owned, "owners"), ["key", "window"]).where("owner < high")
    masks = hit.groupBy("key", "content", "owner").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("m"))
    met = found.select("doc_id", "text_key", "key", "content", "start").join(masks, ["key", "content"]).where("owner < doc_id")
    cut = met.select(
        "doc_id",
        "text_key",
        "start",
        F.expr("filter(sequence(0, 63), i -> getbit(m, i) = 1 AND (i = 0 OR getbit(m, greatest(i - 1, 0)) = 0))").alias("a"),
        F.expr("filter(sequence(0, 63), i -> getbit(m, i) = 1 AND (i = 63 OR getbit(m, least(i + 1, 63)) = 0))").alias("z"),
    )
    s = cut.select("doc_id", "text_key", "start", F.explode(F.arrays_zip("a", "z")).alias("s"))
    return s.select("doc_id", "text_key", (F.col("start") + F.col("s.a")).alias("from"), (F.col("start") + F.col("s.z") + size).alias("to"))


def repeated_stretches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text_key, stretches): word ranges [from, to) covered by windows that also start in a document of smaller doc_id.

    ``text_key`` is the hash of the text, so rows of equal doc_id and other texts stay apart.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(_estimated(base, size))
    found = written(_candidates(base, bits, size), "windows")
    hot = written(_hot_keys(found), "hot-keys")
    few = found.join(F.broadcast(hot), "key", "left_anti")
    classes = few.groupBy("key", "content").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("windows").alias("windows"))
    met = few.select("doc_id", "text_key", "key", "content", "start").join(_owners(classes), ["key", "content"])
    each = met.select("doc_id", "text_key", "start", F.explode("stretches").alias("s")).where(F.col("s.owner") < F.col("doc_id"))
    a = F.col("start") + F.col("s.offset")
    cold = each.select("doc_id", "text_key", a.alias("from"), (a + F.col("s.count") + (size - 1)).alias("to"))
    every = cold.unionByName(_hot_stretches(found.join(F.broadcast(hot), "key", "left_semi"), size))
    return every.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("from", "to")).alias("stretches"))


def remove_repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Removes each word covered by a window of ``size`` words that also starts in a document with a smaller doc_id.

    Returns doc_id, text and all other columns of ``docs`` (those named like
    an output are replaced), then n_words, n_removed and kept_text, the kept
    words joined by one space. Null texts have no words; rows without a
    doc_id neither lose words nor take them from others; repeated rows of one
    doc_id are treated alike and don't remove each other's words; windows
    repeated only within one doc_id stay.
    """
    extra = carried(docs, [*OUTPUTS, "__llm_key", "__llm_stretches"], ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType
    base = docs.select("doc_id", "text", *map(quoted, extra), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__llm_key"))
    found = repeated_stretches(docs, size).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text_key").alias("__llm_key"), F.col("stretches").alias("__llm_stretches"))
    joined = base.join(found, ["doc_id", "__llm_key"], "left").drop("__llm_key")

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            cuts = b.column(b.schema.get_field_index("__llm_stretches")).to_pylist()
            total, gone, kept = [], [], []
            for text, cut in zip(texts, cuts, strict=True):
                ws = (text or "").encode().split()
                total.append(len(ws))
                if cut:
                    mark = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(mark, [c["from"] for c in cut], 1)
                    np.add.at(mark, [c["to"] for c in cut], -1)
                    keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                    ws = [ws[i] for i in keep.tolist()]
                gone.append(total[-1] - len(ws))
                kept.append(b" ".join(ws).decode())
            names = [x for x in b.schema.names if x != "__llm_stretches"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, *OUTPUTS])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*(f for f in joined.schema if f.name != "__llm_stretches"), *(StructField(c, LongType()) for c in OUTPUTS[:2]), StructField(OUTPUTS[2], StringType())])
    return arrow_map(joined, run, schema)
