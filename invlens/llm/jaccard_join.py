"""Exact Jaccard self-join on word shingles by a token-group matrix (operator 8).

Documents with equal shingle sets are one class. Each class is verified against
a few classes that share a rare shingle with it, and what links to one
centre is one group, of which no pair needs a look any more.

The matrix then settles all other classes, linked or not. The classes of a token
are put in order of size and least shingle, so that similar ones lie side by
side, and cut into rows of about ``MEMBERS``. A row holds the union of its members'
tokens as a bitmap. A class asks a token's rows, not its classes: it opens a row only if
the tokens it can share with the union reach what the threshold asks for,
and only members of opened rows are compared one by one.

Which pairs need a look at all follows from the prefix rule: in any one order
of all tokens, sets of Jaccard similarity t or more share a token among the
first ``n - ceil(t n) + 1`` of each. The order puts tokens that a sketch of the
whole corpus estimates frequent last, so a passage common to many documents
brings none of them together. The order decides speed only, never results.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invlens.llm import _text as X
from invlens.llm import sketch
from invlens.llm._store import arrow_map, brought, shuffle_parts, written
from invlens.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Longs of a token bitmap.
BITMAP = 32
#: Longs of the folded bitmap that goes along with each token of a class.
FOLDED = 8
#: Members of one row of the matrix, about.
MEMBERS = 64
#: Classes of one token and size that are put in order by one task, about; more are first cut by their least shingle.
IN_ORDER = 1 << 16
#: Classes of one token that one task asks for, about, and the parts that a token's classes are dealt to at most.
ASKERS, PARTS = 1 << 10, 64
#: Classes in groups that are sent to all executors (16 bytes each), at most; more are joined by a shuffle.
SENT_GROUPS = 1 << 18
_BLOCK = 16


def _few_rows(batches, rows: int = 512):
    """The batches in slices, so that the shingle sets of few rows are held at once."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def _counts_packed(counts: np.ndarray) -> bytes:
    """A block of counts, most of them zero or one: a bit per cell, then the counts that are not zero."""
    met = counts > 0
    return zlib.compress(np.packbits(met).tobytes() + counts[met].tobytes(), 1)


def _counts_unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    counts = np.unpackbits(raw[:1 << (_BLOCK - 3)])
    counts[counts > 0] = raw[1 << (_BLOCK - 3):]
    return counts


def _sizes(docs: DataFrame, k: int, cells: int) -> DataFrame:
    """One pass over the texts: per row doc_id, size and 128-bit hash of its shingle set; per task, blocks of a token count sketch."""

    def run(batches):
        counts = np.zeros(cells, np.uint8)
        names = ["doc_id", "n", "h1", "h2", "block", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in _few_rows(batches):
            sets = list(X.shingle_sets(b.column(1), k, X.SPACE_WORD))
            met, times = np.unique(np.concatenate(sets) & np.uint64(cells - 1), return_counts=True)
            counts[met] = np.minimum(counts[met] + times, 255)
            sums = [_set_hash(s) for s in sets]
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array([h[i] for h in sums], np.uint64).view(np.int64)) for i in (0, 1)), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        for block in np.flatnonzero(counts.reshape(-1, 1 << _BLOCK).any(axis=1)).tolist():
            data = _counts_packed(counts[block << _BLOCK:(block + 1) << _BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, block, data), kinds, strict=True)], names)

    return written(arrow_map(docs, run, "doc_id long, n long, h1 long, h2 long, block int, data binary"), "shingle-sizes")


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    return int(s.sum(dtype=np.uint64)), int(X.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _frequent(sizes: DataFrame, cells: int) -> np.ndarray:
    """A bit per cell of the merged sketch: set where tokens are estimated frequent, well above what chance puts into a cell."""
    spark = sizes.sparkSession
    total = sizes.where(F.col("block").isNull()).agg(F.sum("n")).first()[0] or 0
    limit = 64 + 4 * total // cells

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = _counts_unpacked(data)
                sums[block] = sums[block] + one if block in sums else one.astype(np.uint32)
        for block, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(np.packbits(s >= limit).tobytes(), 1)], pa.binary())], ["block", "data"])

    bits = np.zeros(cells // 8, np.uint8)
    parts = sizes.where(F.col("block").isNotNull()).select("block", "data").repartition(shuffle_parts(spark), "block")
    for block, data in brought(arrow_map(parts, merge, "block int, data binary"), "frequent"):
        one = np.frombuffer(zlib.decompress(data), np.uint8)
        at = block << (_BLOCK - 3)
        bits[at:at + len(one)] = one
    return bits


def _class_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return X.mix(h1.view(np.uint64) ^ X.mix(h2.view(np.uint64)))


def _copied(reps: DataFrame) -> list[np.ndarray]:
    """Sketch bits of the classes that have several rows."""
    several = reps.where("held > 1").select("h1", "h2")
    cells = sketch.cells_for(several.count())

    def keys(batches):
        for b in batches:
            yield np.repeat(_class_key(b.column(0).to_numpy(), b.column(1).to_numpy()), 2)

    return sketch.repeated(sketch.partial(several, keys, cells), cells)


def _prefixes(docs: DataFrame, frequent, k: int, percent: int, copied=None) -> DataFrame:
    """Second pass: per row its set hash, its bitmaps and its first tokens in the order (estimated frequent last, then hash).

    ``alone`` rows are the only one of their class; of the others the sketch ``copied`` leaves it open.
    A set of more tokens than ``bits`` has gets a longer bitmap too.
    """

    def run(batches):
        bits = frequent.value
        for b in _few_rows(batches):
            out, sums, sizes, maps, longer = [], [], [], [], []
            for s in X.shingle_sets(b.column(1), k, X.SPACE_WORD):
                n = len(s)
                take = n - -(-percent * n // 100) + 1 if n else 0
                c = s & np.uint64(len(bits) * 8 - 1)
                late = (bits[c >> np.uint64(3)] >> (7 - (c & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
                out.append((np.concatenate([s[~late], s[late]]) if late.any() else s)[:take])
                sums.append(_set_hash(s))
                sizes.append(n)
                maps.append(_bitmap(s, BITMAP))
                longer.append(_wide(s, 1) if n > 64 * BITMAP else None)
            h1, h2 = (np.array([h[i] for h in sums], np.uint64).view(np.int64) for i in (0, 1))
            alone = ~sketch.maybe_repeated(copied.value, _class_key(h1, h2)) if copied else np.zeros(len(b), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), X.list_array(out), X.list_array(maps), pa.array(longer, pa.list_(pa.int64())), pa.array(alone)], ["doc_id", "n", "h1", "h2", "prefix", "bits", "longer", "alone"])

    return arrow_map(docs, run, "doc_id long, n long, h1 long, h2 long, prefix array<long>, bits array<long>, longer array<long>, alone boolean")


def _classes(docs: DataFrame, reps: DataFrame, frequent, k: int, percent: int) -> DataFrame:
    """(a, n, prefix, bits, longer) of each class; only rows that may have copies are shuffled."""
    copied = docs.sparkSession.sparkContext.broadcast(_copied(reps))
    rows = written(_prefixes(docs, frequent, k, percent, copied).withColumnRenamed("doc_id", "a").where("n > 0"), "prefixes")

    def open_ones(batches):
        for b in batches:
            yield b.filter(pa.array(sketch.maybe_repeated(copied.value, _class_key(b.column(0).to_numpy(), b.column(1).to_numpy()))))

    asked = arrow_map(reps.select("h1", "h2", "n", "a"), open_ones, "h1 long, h2 long, n long, a long")
    least = written(rows.where("NOT alone").join(asked, ["a", "h1", "h2", "n"], "left_semi").select("a", "n", "prefix", "bits", "longer"), "copied-prefixes")
    return rows.where("alone").select("a", "n", "prefix", "bits", "longer").unionByName(least)


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """(token, a, n): the prefix tokens that at least two classes have, with those classes.

    A sketch of all prefix tokens first takes out nearly all that one class
    alone has, before anything is shuffled by token; an exact count follows.
    """
    spark = classes.sparkSession
    cells = sketch.cells_for(int(classes.agg(F.sum(F.size("prefix"))).first()[0] or 0))

    def tokens(batches):
        for b in batches:
            yield b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    bits = spark.sparkContext.broadcast(sketch.repeated(sketch.partial(classes.select("prefix"), tokens, cells), cells))

    def keep(batches):
        for b in batches:
            col = b.column(2)
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(sketch.maybe_repeated(bits.value, flat.view(np.uint64)))
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), pa.array(b.column(0).to_numpy()[row]), pa.array(b.column(1).to_numpy()[row])], ["token", "a", "n"])

    rows = written(arrow_map(classes.select("a", "n", "prefix"), keep, "token long, a long, n long"), "prefix-tokens")
    met = rows.groupBy("token").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where(F.col("lo") < F.col("hi")).select("token")
    return written(rows.join(met, "token"), "shared-tokens")


def _bitmap(s: np.ndarray, longs: int) -> np.ndarray:
    m = np.zeros(64 * longs, np.uint8)
    m[s % np.uint64(64 * longs)] = 1
    return np.packbits(m).view(np.int64)


def _wide(s: np.ndarray, each: int = 4) -> np.ndarray:
    """A bitmap of a set with ``each`` bits a token or more, its length a power of two, so that a longer one folds onto a shorter."""
    return _bitmap(s, max(BITMAP, 1 << max(0, (len(s) - 1) * each // 64).bit_length()))


def _again(docs: DataFrame, wanted: DataFrame, k: int, what, column: str) -> DataFrame:
    """(a, n, ``column``) of the wanted documents, and a few others whose id falls into the same cells: one pass over the texts.

    ``what`` makes the column's numbers from a shingle set.
    """
    cells = sketch.cells_for(wanted.count())

    def ids(batches):
        for b in batches:
            yield np.repeat(X.mix(b.column(0).to_numpy().view(np.uint64)), 2)

    bits = docs.sparkSession.sparkContext.broadcast(sketch.repeated(sketch.partial(wanted, ids, cells), cells))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(sketch.maybe_repeated(bits.value, X.mix(b.column(0).to_numpy().view(np.uint64)))))
            for part in _few_rows([b], 256):
                sets = list(X.shingle_sets(part.column(1), k, X.SPACE_WORD))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), X.list_array([what(s) for s in sets])], ["a", "n", column])

    return written(arrow_map(docs, run, f"a long, n long, {column} array<long>"), f"token-{column}")


def _missing(x: str, y: str):
    """Bits of one bitmap that the other lacks: each stands for at least one token of the first set that the second lacks."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, v: t + v)


def _missing_of(x: str, y: str):
    """As ``_missing`` for two bitmaps of ``BITMAP`` longs, as one sum that Spark compiles."""
    return reduce(Column.__add__, (F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(BITMAP)))


def _with_both(pairs: DataFrame, rows: DataFrame, column: Column) -> DataFrame:
    """Pairs (a, b) with na, ma and nb, mb: size and ``column`` of both. Both selections are alike, so one shuffle of the rows serves them."""
    one, two = (rows.select(F.col("a").alias(f"k{x}"), F.col("n").alias(f"n{x}"), column.alias(f"m{x}")) for x in "ab")
    return pairs.join(one, F.col("a") == F.col("ka")).join(two, F.col("b") == F.col("kb"))


def _bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of near sizes whose bitmaps leave room for the overlap that the threshold asks for; a missing token can't be shared."""
    most = F.least(F.col("na") - _folded_missing("ma", "mb"), F.col("nb") - _folded_missing("mb", "ma"))
    best = F.coalesce("longer", "bits") if "longer" in maps.columns else F.col("bits")
    return _with_both(pairs, maps, best).where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def _folded_missing(x: str, y: str):
    """As ``_missing`` for bitmaps of which one may be twice as long: the longer is folded first."""
    w = F.least(F.size(x), F.size(y))
    fold = lambda c: F.when(F.size(c) == w, F.col(c)).otherwise(F.zip_with(F.slice(F.col(c), F.lit(1), w), F.slice(F.col(c), w + 1, w), lambda p, q: p.bitwiseOR(q)))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, v: t + v)


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: bitmaps as long as the sets need first, then exact intersection."""
    pairs = written(pairs, "class-pairs")
    if pairs.isEmpty():
        return pairs
    both = lambda p: p.select("a").union(p.select("b")).distinct()
    wide = _again(docs, both(pairs), k, _wide, "bitmaps")
    most = F.least(F.col("na") - _folded_missing("ma", "mb"), F.col("nb") - _folded_missing("mb", "ma"))
    near = _with_both(pairs, wide, F.col("bitmaps")).where(_near_sizes("na", "nb", percent)).where((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
    pairs = written(near.select("a", "b").distinct(), "near-pairs")
    if pairs.isEmpty():
        return pairs
    sets = _again(docs, both(pairs), k, lambda s: s, "sets")
    shared = F.size(F.array_intersect("ma", "mb"))
    return written(_with_both(pairs, sets, F.col("sets")).where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b").distinct(), "class-links")


def _near_sizes(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _star_pairs(rows: DataFrame, stars: int, percent: int) -> DataFrame:
    """For each token, its classes against a few of them (the least in so many orders), if their sizes can link."""
    masks = [F.lit(i * 0x5DEECE66D1B54A32 & (1 << 62) - 1) for i in range(stars)]
    least = [F.min(F.struct(F.col("a").bitwiseXOR(m).alias("o"), "n")) for m in masks]
    centres = rows.groupBy("token").agg(F.array_distinct(F.array(*[F.struct(x["o"].bitwiseXOR(m).alias("b"), x["n"].alias("nb")) for x, m in zip(least, masks, strict=True)])).alias("centres"))
    met = rows.join(centres, "token").select("a", "n", F.explode("centres").alias("f")).select("a", "n", "f.*").where((F.col("a") != F.col("b")) & _near_sizes("n", "nb", percent))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _groups(links: DataFrame) -> DataFrame:
    """(a, g): classes that a chain of at most three links connects with the same class g. Classes without links are not returned."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("g"))
    return first.join(first.select(F.col("a").alias("g"), F.col("g").alias("on")), "g").select("a", F.col("on").alias("g"))


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Token rows with their class's group, of the tokens that several groups have."""
    groups = written(groups, "class-groups")
    if groups.count() <= SENT_GROUPS:  # else the token rows, in order of token, would be shuffled by class in between
        groups = F.broadcast(groups)
    named = rows.select("token", "a", "n").join(groups, "a", "left").withColumn("g", F.coalesce("g", "a"))
    several = named.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("held")).where(F.col("lo") < F.col("hi")).select("token", "held")
    return written(named.join(several, "token"), "grouped-tokens")


def _single_row_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """As ``_matrix_pairs`` for tokens whose classes are one matrix row: its members meet at once, by bitmaps folded to ``FOLDED`` longs."""
    folded = F.array(*(reduce(Column.bitwiseOR, [F.col("bits")[j] for j in range(i, BITMAP, FOLDED)]) for i in range(FOLDED)))
    small = rows.join(classes.select("a", folded.alias("s")), "a").select("token", "a", "n", "g", "s").repartition("token")  # dealt once for both sides
    one = small.select("token", "a", "n", "g", F.col("s").alias("ma"))
    two = small.select(F.col("token").alias("t"), F.col("a").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"), F.col("s").alias("mb"))
    most = F.least(F.col("n") - _missing("ma", "mb"), F.col("nb") - _missing("mb", "ma"))
    near = (F.col("a") > F.col("b")) & (F.col("g") != F.col("gb")) & _near_sizes("n", "nb", percent) & ((100 + percent) * most >= percent * (F.col("n") + F.col("nb")))
    pairs = one.join(two, (F.col("token") == F.col("t")) & near).select("a", "b").distinct()
    return _bounded(pairs, classes, percent)


def _matrix_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Class pairs of different groups that share a prefix token, of those matrix rows only that the bound leaves open.

    A token of the query whose bit a row's union lacks is in none of its members, so
    ``n - missing`` bounds the overlap; with a smaller member (n_b <= n_a) the
    threshold asks for ``percent`` of n_a at least. A token's classes meet its rows, one for about
    ``MEMBERS`` classes, which carry their members along; the bound, and for open rows the members' own
    bitmaps, are conditions of the join, so only rows with a near member leave it. The classes of a frequent
    token ask in several parts, each of which has all rows of the token.
    Tokens of up to ``MEMBERS`` classes are one row each, see ``_single_row_pairs``.
    """
    few = _single_row_pairs(rows.where(F.col("held") <= MEMBERS), classes, percent)
    rows = rows.where(F.col("held") > MEMBERS)
    known = classes.select("a", "bits", F.array_min("prefix").alias("least"))
    placed = rows.join(known, "a").withColumn("band", F.floor(F.log(F.col("n")) * 10).cast("int"))
    cut = F.pmod(F.xxhash64("least"), F.ceil(F.col("held") / IN_ORDER))
    order = Window.partitionBy("token", "band", "cut").orderBy("least", "a")
    at = F.floor((F.row_number().over(order) - 1) / MEMBERS)
    placed = written(placed.withColumn("cut", cut).select("token", "a", "n", "g", "bits", F.xxhash64("token", "band", "cut", at).alias("row"), F.least(F.ceil(F.col("held") / ASKERS), F.lit(PARTS)).alias("parts")), "matrix-members")
    unions = [F.bit_or(F.col("bits")[i]).alias(f"u{i}") for i in range(BITMAP)]
    member = F.struct(F.col("a").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"), F.col("bits").alias("mb"))
    matrix = placed.groupBy("token", "row").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("g").alias("glow"), F.max("g").alias("ghigh"), F.max("parts").alias("parts"), F.collect_list(member).alias("members"), *unions)
    matrix = matrix.select(F.col("token").alias("t"), "low", "high", "glow", "ghigh", "members", F.array(*[f"u{i}" for i in range(BITMAP)]).alias("union"), F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("for"))
    ask = placed.select("token", "a", "n", "g", F.col("bits").alias("ma"), (F.pmod(F.xxhash64("a"), "parts") + 1).alias("part"))
    tasks = shuffle_parts(ask.sparkSession)  # given, so that Spark doesn't draw small rows with much work together, whichever side it sends
    ask, matrix = ask.repartition(tasks, "token", "part"), matrix.repartition(tasks, "t", "for")
    sized = (F.col("low") <= F.col("n")) & (100 * F.col("high") >= percent * F.col("n")) & ~((F.col("glow") == F.col("g")) & (F.col("ghigh") == F.col("g")))
    opened = sized & (100 * (F.col("n") - _missing_of("ma", "union")) >= percent * F.col("n"))

    def near(m):
        most = F.least(F.col("n") - _missing("ma", m["mb"]), m["nb"] - _missing(m["mb"], "ma"))
        return (m["nb"] <= F.col("n")) & (F.col("g") != m["gb"]) & _near_sizes("n", m["nb"], percent) & ((100 + percent) * most >= percent * (F.col("n") + m["nb"]))

    met = ask.join(matrix, (F.col("token") == F.col("t")) & (F.col("part") == F.col("for")) & opened & F.exists("members", near)).select("a", F.explode(F.filter(F.transform("members", lambda m: F.when(near(m), m["b"])), lambda b: b.isNotNull())).alias("b"))
    return few.union(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, stars: int = 3, cells: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (set size) and component_id, the smallest doc_id reachable by links, itself included.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of lower-cased (A-Z) k-word shingles; a text of fewer words is one
    shingle; null and empty texts have none and link with nothing. Rows of one
    doc_id count as one document; a row without doc_id links with nothing and
    has no component. Extra columns are ignored.

    Texts are read in two passes and four more at most to verify candidates;
    they are never shuffled. ``stars`` classes per shared token are tried as centres;
    the matrix then settles all pairs of classes in different groups. Pairs
    inside a group need no check: they are connected already.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if cells is None:
        chars = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = min(1 << 26, max(1 << 20, 1 << (int(chars) // 200).bit_length()))
    sizes = _sizes(base, k, cells)
    rows = sizes.where(F.col("block").isNull()).select("doc_id", "n", "h1", "h2")
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    reps = written(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("held")), "classes")
    frequent = spark.sparkContext.broadcast(_frequent(sizes, cells))
    texts = base.where(F.col("doc_id").isNotNull())
    classes = _classes(texts, reps, frequent, k, percent)
    shared = _shared_tokens(classes)
    links = _verified(_bounded(_star_pairs(shared, stars, percent), classes, percent), texts, k, percent)
    rest = _grouped(shared, _groups(links))
    if not rest.isEmpty():
        links = links.unionByName(_verified(_matrix_pairs(rest, classes, percent), texts, k, percent))
    groups = components(links)
    of_class = reps.drop("held").join(groups.withColumnRenamed("node", "a"), "a", "left").select("h1", "h2", "n", F.coalesce("component", "a").alias("component"))
    out = rows.join(of_class, ["h1", "h2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("c"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").cast(kind).alias("component_id"))
