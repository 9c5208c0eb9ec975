"""Linked rows: groups that links connect, and the last row of a chain of corrections. Rounds grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.checkpoints import cut


def groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, group: the least node that it is connected with, for every node (a long) of ``links``.

    Each round joins a node's larger neighbours to its least one, then its smaller ones; only minima are grouped, so a
    node with many links is no group of rows. Nulls link nothing; a node linked with itself is a group of its own.
    """
    own = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    nodes = own.select(F.col("u").alias("node")).union(own.select("v")).distinct()
    edges = cut(own.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct())
        # the same edges again: every group is a star around its least node
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("group")), "node", "left").select("node", F.coalesce("group", "node").alias("group"))


def chain_ends(rows: DataFrame, row_id: str, follows: str) -> DataFrame:
    """``row_id`` and ``last``: where following the links from each row ends.

    ``follows`` names the row that a row leads to; null, an unknown row or itself ends the chain. Each round doubles the
    step. Rows of a circle lead nowhere and get null.
    """
    known = rows.select(F.col(row_id).alias("id"), F.col(follows).alias("to"))
    known = known.join(known.select(F.col("id").alias("to"), F.lit(True).alias("exists")).distinct(), "to", "left")
    at = cut(known.select("id", F.when(F.col("exists") & (F.col("to") != F.col("id")), F.col("to")).alias("to")))
    left, rounds = at.where(F.col("to").isNotNull()).count(), 0
    at = at.select("id", F.coalesce("to", "id").alias("at"))
    ends = at.where("id = at").select(F.col("id").alias("end"))
    while left and 2**rounds < 2 * left:
        step = at.select(F.col("id").alias("at"), F.col("at").alias("next"))
        at, rounds = cut(at.join(step, "at").select("id", F.col("next").alias("at"))), rounds + 1
        if not at.join(ends, at["at"] == ends["end"], "left_anti").limit(1).count():
            break
    return at.join(ends, at["at"] == ends["end"], "left").select(F.col("id").alias(row_id), F.col("end").alias("last"))
