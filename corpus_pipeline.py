"""A training-data pipeline over ``documents``: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
it kept; ``run`` writes each result as Parquet to the shared folder and reads
it again as the next stage's documents. All but the last stage return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.llm import decontamination, jaccard_join, packing, substring_dedup, toxicity
from invlens.llm._cols import quoted
from invlens.llm._store import written
from invlens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def apart(docs: DataFrame):
    """``docs`` with all columns but doc_id and text under names that no operator uses, and the way back.

    So an operator's outputs never stand in for a document's own column of that name,
    and names with dots or quotes reach no operator.
    """
    kept = {c: c if c in ("doc_id", "text") else f"__own_{i}" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(own).alias(c) for c, own in kept.items()))

    return docs.select(*(quoted(c).alias(own) for c, own in kept.items())), back


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay. The network learns from these documents and the labels, never from held-out rows."""
    own, back = apart(docs)
    net = toxicity.train(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score_toxicity(own, net).where("predicted = 0"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest doc_id stays; documents without words stay.

    Rows repeated with their doc_id and text are one document, of which the row of
    least other columns stays. A row without doc_id takes part under a number
    made from its text that is greater than all real ids, so of equal texts without id
    one stays, and none beside a near duplicate that has an id.
    """
    own, back = apart(docs)
    made = F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    rows = own.select("*", F.coalesce(F.col("doc_id").cast("long"), made).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"))
    keys = ["__id", "__hash"]
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    if not again.isEmpty():
        repeats = rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*own.columns)).alias("row")).select("row.*", *keys)
        rows = rows.join(again, keys, "left_anti").unionByName(repeats)
    found = jaccard_join.jaccard_components(rows.select(F.col("__id").alias("doc_id"), "text"))
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__id")).distinct()
    return back(rows.join(gone, "__id", "left_anti"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; a document of which nothing is left goes.

    Untouched texts stay as they are; of the others the kept words are joined
    by one space, and n_chars is counted anew.
    """
    own, back = apart(docs)
    kept = substring_dedup.remove_repeated_windows(own).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    out = kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        count = f"__own_{docs.columns.index('n_chars')}"
        out = out.withColumn(count, F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(count)))
    return back(out)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; of an item under five words only a text that is that item as a whole."""
    own, back = apart(docs)
    return back(decontamination.without_contaminated(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences of 4096 tokens, one row per piece."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained network nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
