"""Connected components of a large graph by repeated contraction, in shuffles of edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of edges (a, b); the nodes of a component share a root, which is one of them.

    Each round every node joins the member of its neighbourhood, itself included,
    that a fresh random order puts first; the graph of those members goes on. A
    round leaves a fixed share of the nodes, whatever the shape of the graph.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("id"))
        both = edges.select(F.col("a").alias("node"), order("b").alias("o")).unionByName(edges.select(F.col("b").alias("node"), order("a").alias("o")))
        best = both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least(F.col("o"), order("node"))["id"].alias("parent"))
        step = stored(best, "parents")
        steps.append(step)
        ends = edges.join(step.toDF("a", "pa"), "a").join(step.toDF("b", "pb"), "b").filter("pa <> pb")
        edges = stored(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[-1].toDF("node", "root")
    for step in reversed(steps[:-1]):
        later = roots.toDF("parent", "root")
        roots = stored(step.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")), "roots")
    return roots
