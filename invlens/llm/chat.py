"""Cumulative-snapshot collapse of logged conversations, then chat rendering (operator 6), in DataFrame functions only.

Each turn has a rolling hash of all turns up to it: the running exclusive or of
two 64-bit hashes of (position, role, text). A conversation whose last hash is
a rolling hash of a longer one, at the same position, is a prefix of that one,
and an anti-join takes it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Template of one turn, after the widely used ChatML layout.
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Tasks over which the ids of equal conversations are spread.
SALTS = 64


def collapse(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, turns, copy_of.

    Turns stand in the order of ``turn`` (nulls first), then role and text.
    A null role counts as ``user``, a null text as empty; repeated rows of one
    conversation (same turn, role and text) count once; rows without conv_id
    are left out, as nothing says which conversation they belong to. Equal
    conversations prefix no longer one and so all stay; ``copy_of`` is the
    least conv_id among them. Extra columns are ignored.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    once = rows.withColumn("same", same).where(~F.col("same")).drop("same").withColumn("at", F.row_number().over(order))
    hashed = once.withColumns({h: F.bit_xor(F.xxhash64(F.lit(i), "at", "role", "text")).over(so_far) for i, h in enumerate(("h1", "h2"))})
    turns = F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text", "h1", "h2")))
    convs = hashed.groupBy("conv_id").agg(turns.alias("t")).withColumn("n_turns", F.size("t")).withColumn("last", F.struct("n_turns", F.element_at("t", -1)["h1"].alias("h1"), F.element_at("t", -1)["h2"].alias("h2")))
    inner = convs.select(F.explode(F.slice("t", 1, F.col("n_turns") - 1)).alias("x")).select(F.struct(F.col("x.at").alias("n_turns"), "x.h1", "x.h2").alias("last")).distinct()
    # Which conversations stay is settled on ids and hashes alone. Of many equal conversations only one row a task reaches the
    # hash they share; on the way back their ids are spread over SALTS tasks. Texts are never dealt out by hash: they stay by conv_id.
    ends = convs.select("conv_id", "last")
    settled = ends.groupBy("last").agg(F.min("conv_id").alias("copy_of")).join(inner, "last", "left_anti")
    spread = settled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = ends.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(spread, ["last", "salt"]).select("conv_id", "copy_of")
    kept = convs.join(ids, "conv_id")
    plain = F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))
    return kept.select("conv_id", "n_turns", plain.alias("turns"), "copy_of")


def render(convs: DataFrame) -> DataFrame:
    """Adds ``rendered``: every turn between its markers."""
    turn = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    return convs.withColumn("rendered", F.array_join(F.transform("turns", turn), ""))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copy_of and rendered text of each maximal conversation."""
    return render(collapse(conversations)).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copy_of", "rendered")
