"""Spelling variants by pivotal grams: near words one edit apart, and each word's most frequent form.

Bigrams are ordered by rarity over the vocabulary. A word's prefix is its
``PREFIX`` rarest bigrams (with every further place of the last one's bigram).
Two disjoint bigrams of the prefix are its pivots, chosen by dynamic
programming over their places: the cost of a pivot is its frequency, less for
each letter between it and the word's end that it has to itself, since that
part then joins fewer words. One edit stands either after the first
pivot, and everything up to the pivot's end is the same in both words, or before the
second, and everything from its start is. So, of two near words, the one whose
prefix ends earlier in the order of rarity has a pivot in the other's prefix,
at the same distance from the word's start (first pivot) or from its end
(second pivot), with the same letters up to there, and a length that differs by one at
most. Pivots join prefixes on these three. Sets of letters and bigrams as
64-bit words and then the edit distance decide inside the join, so that only
near pairs leave it.

All of it is DataFrame functions on the executors. What reaches the driver is
the frequency of each bigram, at most ``LETTERS ** 2`` numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invlens.llm._store import written
from invlens.llm.licenses import LOWER, UPPER

#: Code points of a word, least: runs of these letters. Only A-Z are lower-cased, so U+00C0 to U+00DE stay as they are.
LEAST_LENGTH = 7
RUN = "[A-Za-zÀ-ÿ]{%d,}"
#: Letters are numbered a-z 1 to 26, U+00C0 to U+00FF 27 to 90.
LETTERS = 91
#: Rarest bigrams in a prefix; three are enough for one edit, more give the pivots a choice.
PREFIX = 4
#: What one more letter of its own leaves of the words that a pivot joins, roughly.
OWN_LETTER = 1 / 6


def counted_words(docs: DataFrame, damage: int = 31, least_length: int = LEAST_LENGTH, least_count: int = 2) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) met ``least_count`` times or more over all documents.

    Where ``damage`` divides the unsigned crc32 h of ``<doc_id>:<run>``, the
    code point at h modulo the run's length is left out first, in every
    occurrence in that document. Null texts have no words; in rows without
    doc_id nothing is left out. A maximal run shorter than ``least_length``
    cannot become a word, so the pattern asks for that length at once.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN % least_length), F.lit(0))).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    word = F.when(F.pmod(h, F.lit(damage)) == 0, cut).otherwise(run)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _with_bigrams(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` with the word's bigrams as numbers, by place from 0; linear in the word's length."""
    letters = F.transform(F.split("word", ""), lambda c: F.ascii(c))
    numbers = F.transform(F.filter(letters, lambda c: c > 0), lambda c: F.when(c < 128, c - 96).otherwise(c - 165).cast("int"))
    n = F.size("numbers") - 1
    pairs = F.zip_with(F.slice("numbers", 1, n), F.slice("numbers", 2, n), lambda x, y: x * LETTERS + y)
    return vocabulary.withColumn("numbers", numbers).select("word", "n", "numbers", pairs.alias("grams"))


def _frequencies(vocabulary: DataFrame) -> Column:
    """Occurrences of every bigram over the vocabulary, as a constant array indexed by the bigram's number."""
    counts = [0] * (LETTERS * LETTERS)
    for g, n in _with_bigrams(vocabulary).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1))).collect():
        counts[g] = n
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")


def _pivots(prefix: Column, length: Column) -> Column:
    """Places of two disjoint bigrams out of ``prefix`` (array of f, g, p), by dynamic programming over places; least cost wins.

    Going through the places in order, ``before`` is the cheapest first pivot that
    ends before or overlaps only the last bigram seen, ``last`` is that last one, which the
    next may overlap, and ``best`` is the best pair so far.
    """
    one, pair = "struct<c:double,p:int>", "struct<c:double,p1:int,p2:int>"
    start = F.struct(F.lit(None).cast(one).alias("before"), F.lit(None).cast(one).alias("last"), F.lit(None).cast(pair).alias("best"))

    def step(s, x):
        here = F.struct((x["f"] * F.pow(F.lit(OWN_LETTER), x["p"])).alias("c"), x["p"].alias("p"))
        free = F.when(s["last"]["p"] <= x["p"] - 2, F.least(s["before"], s["last"])).otherwise(s["before"])
        second = x["f"] * F.pow(F.lit(OWN_LETTER), length - 2 - x["p"])
        made = F.when(free.isNotNull(), F.struct((free["c"] + second).alias("c"), free["p"].alias("p1"), x["p"].alias("p2")))
        return F.struct(F.least(s["before"], s["last"]).cast(one).alias("before"), here.cast(one).alias("last"), F.least(s["best"], made).cast(pair).alias("best"))

    by_place = F.array_sort(F.transform(prefix, lambda x: F.struct(x["p"].alias("p"), x["f"].alias("f"))))
    return F.aggregate(by_place, start, step)["best"]


def _bits(numbers: Column) -> Column:
    """A set of numbers as the bits of one 64-bit word."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x * 37, F.lit(64)))))


def indexed(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` with each word's length, sets of letters and bigrams, prefix (f, g, p) and pivot places p1 < p2."""
    f = _frequencies(vocabulary)
    by_rarity = F.array_sort(F.transform("grams", lambda g, i: F.struct(f[g].alias("f"), g.alias("g"), i.alias("p"))))
    ordered = _with_bigrams(vocabulary).select("word", "n", F.size("numbers").alias("len"), _bits(F.col("numbers")).alias("letters"), _bits(F.col("grams")).alias("pairs"), by_rarity.alias("grams"))
    end = F.element_at("grams", F.least(F.lit(PREFIX), F.size("grams")))
    prefix = F.filter("grams", lambda x: F.struct(x["f"], x["g"]) <= F.struct(end["f"], end["g"]))
    chosen = ordered.withColumn("prefix", prefix).drop("grams")
    return chosen.withColumn("pivots", _pivots(F.col("prefix"), F.col("len"))).select("*", "pivots.p1", "pivots.p2").drop("pivots")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words exactly one inserted, deleted or replaced code point apart."""
    words = indexed(vocabulary)
    word, length = F.col("word"), F.col("len")

    def head(p, l):  # the word up to the end of the bigram at p
        return F.xxhash64(F.lit(0), l, F.substr(word, F.lit(1), p + 2))

    def tail(p, l):  # the word from the bigram at p on
        return F.xxhash64(F.lit(1), l, F.substr(word, p + 1))

    asked = F.array(*(part(F.col(p), length + d) for part, p in ((head, "p1"), (tail, "p2")) for d in (-1, 0, 1)))
    held = F.flatten(F.transform("prefix", lambda x: F.array(head(x["p"], length), tail(x["p"], length))))
    own = ["n", "letters", "pairs", "word"]
    keyed = written(words.select(*own, asked.alias("asked"), held.alias("held")), "spelling-keys")
    asks = keyed.select(*(F.col(c).alias(f"a_{c}") for c in own), F.explode("asked").alias("key"))
    index = keyed.select(*(F.col(c).alias(f"b_{c}") for c in own), F.explode("held").alias("b_key"))
    near = (F.bit_count(F.col("a_pairs").bitwiseXOR(F.col("b_pairs"))) <= 4) & (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2) & (F.levenshtein("a_word", "b_word", 1) == 1)
    found = asks.join(index, (F.col("key") == F.col("b_key")) & near)

    def row(x, y):
        return F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("near"), F.col(f"{y}_n").alias("near_n"))

    return found.select(F.explode(F.array(row("a", "b"), row("b", "a"))).alias("x")).select("x.*").distinct()


def _roots(forms: DataFrame, greatest: int) -> DataFrame:
    """(word, root) for ``forms`` (word, form): forms followed to the last, twice as far in each round.

    A form is at least ten times as frequent as its word, so a chain has at most
    as many steps as ``greatest``, the largest count, has digits; that bounds the rounds.
    """
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(len(str(max(1, greatest))).bit_length()):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return at


def spelling_variants(docs: DataFrame, damage: int = 31, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every counted word of ``docs`` (doc_id, text).

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that
    n is at least ``ratio`` times the word's, else null. Documents without
    text and empty tables give no words; repeated rows count as often as
    they stand; other columns are ignored.
    """
    vocabulary = written(counted_words(docs, damage), "spelling-words")
    greatest = vocabulary.agg(F.max("n")).first()[0] or 0
    best = near_pairs(vocabulary).groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near"))).alias("best"), F.count(F.lit(1)).alias("n_near"))
    enough = -F.col("best.k") >= ratio * F.col("n")
    all_words = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.k")).alias("form_n"))
    all_words = written(all_words, "spelling-forms")
    roots = _roots(all_words.where(F.col("form").isNotNull()).select("word", "form"), greatest)
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
