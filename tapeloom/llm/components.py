"""Connected components by random-mate contraction, in SQL joins.

Each round every vertex tosses a coin that depends on the vertex and the round. A tails vertex with a heads neighbour is
collapsed into the least such neighbour; edges are renamed and loops and repeats removed. About a quarter of the vertices with edges
vanish a round, so the edges are gone after some ``log(vertices)`` rounds. The collapses are then unwound, last round first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.stage import staged

_MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u BIGINT, v BIGINT) to (vertex, component): the least vertex of each vertex's component.

    Edges may be repeated, looped or given in either direction; rows with a NULL end join nothing and are ignored. A
    vertex without edges is not in the result. No component's rows are ever gathered in one task: a hub's edges are
    spread by their other end, and the join that renames them is split by AQE.
    """
    edges = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u < v").distinct(), "edges")
    every = edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    collapses: list[DataFrame] = []
    for turn in range(_MOST_ROUNDS):
        if edges.isEmpty():
            break
        heads = lambda c, turn=turn: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2)) == 0
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        into = staged(both.where(~heads("u") & heads("v")).groupBy("u").agg(F.min("v").alias("into")), "mates")
        collapses.append(into)
        renamed = edges
        for end in ("u", "v"):
            renamed = renamed.join(into.select(F.col("u").alias(end), F.col("into").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        edges = staged(renamed.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"edges left after {_MOST_ROUNDS} rounds")
    # A vertex collapsed in round k points at one that was alive after round k: later rounds' answers are needed first.
    root: DataFrame | None = None
    for into in reversed(collapses):
        step = into.select(F.col("u").alias("vertex"), F.col("into").alias("component"))
        if root is not None:
            later = root.select(F.col("vertex").alias("component"), F.col("component").alias("_later"))
            step = step.join(later, "component", "left").select("vertex", F.coalesce("_later", "component").alias("component"))
            root = staged(root.unionByName(step), "roots")
        else:
            root = step
    if root is None:
        return every.select("vertex", F.col("vertex").alias("component"))
    labelled = every.join(root, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("root"))
    least = labelled.groupBy("root").agg(F.min("vertex").alias("component"))
    return labelled.join(least, "root").select("vertex", "component")
