"""Buckets of candidate pairs, cut to bounded tasks, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def tasks(rows: DataFrame, block: int) -> DataFrame:
    """rows (bucket, key, others) with i, j and side: what a task (bucket, i, j) compares.

    A bucket of up to `block` rows is one task with i = j = 0. A larger one is cut into blocks by key; each pair of
    blocks is a task, and a row goes to the tasks of its block: side tells whether it is on i's side (0) or j's (1).
    Buckets of one row are left out.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    sized = rows.join(sizes, "bucket")
    cut = F.ceil(F.col("__n") / block).cast("int")
    own = F.when(cut == 1, 0).otherwise(F.pmod(F.xxhash64("key", F.lit(5)), cut)).cast("int")
    sized = sized.withColumns({"__cut": cut, "__own": own})
    dealt = sized.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__cut") - 1)))
    return dealt.withColumns({"i": F.least("__own", "__other"), "j": F.greatest("__own", "__other"), "side": (F.col("__own") > F.col("__other")).cast("int")}).drop("__n", "__cut", "__own", "__other")


def lowest(keys: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """For each key of a task the least one that its pairs (two rows of places) lead to."""
    out = keys.copy()
    while True:
        before = out.copy()
        np.minimum.at(out, pairs[0], before[pairs[1]])
        np.minimum.at(out, pairs[1], before[pairs[0]])
        if (out == before).all():
            return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the same for all nodes of a component) for the nodes of edges (a, b), whose numbers must be in
    random order, such as hashes.

    In each round a node goes to its least neighbour if that is less, and edges are drawn between where their ends
    went; with random numbers the edges that are left shrink by a factor a round. Each round is written to the shared
    folder.
    """
    both = edges.where("a <> b").select("a", "b")
    both = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        parents = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "parents")
        rounds.append(parents)
        one = both.join(parents.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").select("b", "x")
        two = one.join(parents.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        both = stage(two.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if not rounds:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for parents in rounds[1:]:
        out = out.join(parents.select(F.col("node").alias("root"), F.col("root").alias("__next")), "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    return out
