"""Connected components of an edge table by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): each vertex of an edge with one vertex of its component, the same for all of it, as (v, root).

    Randomised contraction: in each round a vertex goes into the one of itself and its neighbours that is first in a
    hash order of that round, and edges move along.  In expectation a fixed share of the vertices goes each time, long
    chains included, so all rounds together join a few times the edges.  The rounds' tables lie in the shared folder;
    when no edge is left, the roots are handed back from the last round to the first.
    """
    rest = common.stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while rest.limit(1).count():
        place = lambda v: F.xxhash64(F.lit(len(steps)), v)
        first = F.min(F.struct(place("b").alias("h"), F.col("b").alias("v")))
        own = F.struct(place("a").alias("h"), F.col("a").alias("v"))
        step = common.stored(rest.groupBy("a").agg(first.alias("near")).select(F.col("a").alias("v"), F.least("near", own).getField("v").alias("root")), "step")
        moved = rest.join(step.select(F.col("v").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("root").alias("y")), "b")
        rest = common.stored(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        steps.append(step)
    if not steps:
        return rest.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = steps.pop()
    while steps:
        later = roots.select(F.col("v").alias("root"), F.col("root").alias("far"))
        roots = common.stored(steps.pop().join(later, "root", "left").select("v", F.coalesce("far", "root").alias("root")), "roots")
    return roots
