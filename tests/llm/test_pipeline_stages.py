"""Every pipeline stage on hard rows: nulls, repeats, rows without id, long texts, clashing and odd column names."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from invlens.llm import decontamination, substring_dedup
from llm_fixtures import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)

LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (0, "one two three four five six seven", 33),
    (0, "one two three four five six seven", 33),
    (1, None, None),
    (2, "", 0),
    (3, LONG, len(LONG)),
    (4, "start " + LONG + " stop", None),
    (5, LONG, 1),
    (None, "a row without an id one two three", 5),
    (None, "a row without an id one two three", 5),
    (None, LONG, 7),
    (None, None, None),
    (6, "paris", 5),
    (7, "x" * 60_000, 60_000),
    (8, "rivers run to paris and back again", 4),
]
CLASH = {"score": 1.5, "predicted": "mine", "n_words": "mine", "n_removed": -1, "kept_text": "mine", "component_id": 9, "stretches": "s", "a.b": "dot", "back`tick": "tick", "__llm_key": 3, "key": "k"}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long")
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df.repartition(4)


def taken(df):
    return sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["toxicity", "jaccard_join", "substring_dedup", "decontamination"])
def test_columns_come_back_as_they_were(spark, rows, name):
    out = STAGES[name](spark, rows, SF)
    assert out.dtypes == rows.dtypes
    for r in out.collect():
        assert all(r[c] == v for c, v in CLASH.items())


def test_toxicity_keeps_clean_rows(spark, rows):
    assert taken(STAGES["toxicity"](spark, rows, SF)) == sorted(ROWS, key=str)


def test_near_duplicates(spark, rows):
    """Of repeated rows one stays, of rows without id too; an id-less near duplicate of a row with an id goes."""
    got = taken(STAGES["jaccard_join"](spark, rows, SF))
    want = [r for r in {*ROWS} if r not in {(5, LONG, 1), (4, "start " + LONG + " stop", None), (None, LONG, 7)}]
    assert got == sorted(want, key=str)


def test_substring(spark, rows):
    got = taken(STAGES["substring_dedup"](spark, rows, SF))
    want = [r for r in ROWS if r[0] not in (4, 5)] + [(4, "start stop", None)]
    assert [g[:2] for g in got if g[0] != 4] == [w[:2] for w in sorted(want, key=str) if w[0] != 4]
    assert [(g[1], g[2]) for g in got if g[0] == 4] == [("start stop", 10)]


def test_short_items_take_out_only_whole_texts(spark, rows):
    items = spark.createDataFrame([(1, "Paris"), (2, None), (3, ""), (4, LONG), (5, "without an id")], "item_id long, text string")
    kept = taken(decontamination.without_contaminated(rows.select("doc_id", "text", "n_chars"), items))
    assert kept == sorted((r for r in ROWS if r[1] != "paris" and LONG not in (r[1] or "")), key=str)
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(rows, items).collect()}
    assert {(6, 1), (8, 1), (3, 4), (None, 5)} <= found  # the operator itself reports every containment


def test_windows_alike_in_six_bytes_are_not_equal(spark):
    """Window hashes that share their first bytes own each other's words neither in a cold nor in a hot key."""
    w = substring_dedup.WIDTH
    assert w > 8
    alike = [b"\x01" * (w - 1) + bytes([i]) for i in range(3)]
    cold = spark.createDataFrame(
        [(1, 10 + i, 5 * i, 5 * i + 3, alike[i]) for i in range(3)] + [(2, 20, 1, 9, b"\x07" * w + b"\x08" * w), (2, 21, 4, 9, b"\x08" * w)], "key long, content long, low long, high long, windows binary"
    )
    got = {(r["key"], r["content"]): [(s["owner"], s["offset"], s["count"]) for s in r["stretches"]] for r in substring_dedup._owners(cold).collect()}
    assert got[1, 11] == [(5, 0, 1)] and got[1, 12] == [(10, 0, 1)]  # each owned by its own least document
    assert got[2, 21] == [(1, 0, 1)]
    found = spark.createDataFrame([(d, d, 1, 0, alike[i]) for i, d in enumerate((3, 4, 5))] + [(6, 6, 1, 2, alike[0])], "doc_id long, text_key long, key long, start long, windows binary").withColumn("content", F.xxhash64("windows"))
    hot = {(r["doc_id"], r["from"], r["to"]) for r in substring_dedup._hot_stretches(found, 50).collect()}
    assert hot == {(6, 2, 52)}


def test_find_without_weak_items():
    ix = decontamination.build_index([(1, "yes"), (2, "one two three four five six")], 5, 80)
    texts = pa.array(["yes", "oh yes", "YES!", "so one two three four five six then", None])
    assert sorted(r for r, i, _ in decontamination.find(texts, ix, 5, 80)) == [0, 1, 2, 3]
    assert sorted(r for r, i, _ in decontamination.find(texts, ix, 5, 80, weak=False)) == [0, 2, 3]
