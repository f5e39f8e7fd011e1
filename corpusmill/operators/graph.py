"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusmill.plans.scratch import materialize, remove

FEW_EDGES = 200_000  # rows, each edge counted in both directions, that one task follows to the end


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge.

    Self-loops and repeated edges do no harm; null ends are ignored.  Nodes without edges are not returned.  Nodes that
    are no integers are numbered in their order first, so that all rounds aggregate longs.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    kind = ends.schema["u"].dataType
    if isinstance(kind, IntegralType):
        found = _of_longs(ends.select(F.col("u").cast("long"), F.col("v").cast("long")), max_rounds)
        return found.select(F.col("node").cast(kind), F.col("component").cast(kind))
    ends = materialize(ends.distinct(), "ends")
    # numbers go up along the partitions of the sort, so the smallest number is the smallest name
    names = ends.select(F.col("u").alias("name")).union(ends.select("v")).distinct().orderBy("name")
    names = materialize(names.select("name", F.monotonically_increasing_id().alias("id")), "names")

    def joined(table: DataFrame, column: str, name: str, number: str) -> DataFrame:
        return table.join(names.select(F.col("name").alias(name), F.col("id").alias(number)), column)

    numbered = joined(joined(ends, "u", "u", "x"), "v", "v", "y").select(F.col("x").alias("u"), F.col("y").alias("v"))
    found = _of_longs(numbered, max_rounds)
    out = materialize(joined(joined(found, "node", "its", "node"), "component", "smallest", "component").select(F.col("its").alias("node"), F.col("smallest").alias("component")), "components")
    remove(ends, names, found)
    return out


def _of_longs(ends: DataFrame, max_rounds: int) -> DataFrame:
    """Components by randomised contraction.

    In every round each node joins the neighbour (or itself) that comes first in an order drawn anew by hash, and then
    that neighbour's choice.  Edges are rewritten to what their ends joined; repeated ones and those inside one part
    leave, so the table shrinks by a constant share whatever the graph's shape.  What is left at FEW_EDGES rows or fewer
    is followed by one task at once, which gives the same components in fewer jobs.  At the end the rounds' choices are
    followed from the last to the first, each over the few nodes that were left then.
    """

    def order(column: str) -> Column:
        return F.xxhash64(F.lit(len(rounds)), F.col(column))

    rounds: list[DataFrame] = []
    now = materialize(ends.union(ends.select("v", "u")).distinct(), "edges")
    while True:
        left = now.count()
        if left <= FEW_EDGES:
            if left or not rounds:
                rounds.append(materialize(now.coalesce(1).mapInArrow(_followed, "node long, label long"), "choices"))
            remove(now)
            break
        if len(rounds) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        best = now.groupBy("u").agg(F.min_by("v", order("v")).alias("v"), F.min(order("v")).alias("first"))
        best = best.select(F.col("u").alias("node"), F.when(F.col("first") < order("u"), F.col("v")).otherwise(F.col("u")).alias("to"))
        further = best.select(F.col("node").alias("to"), F.col("to").alias("label"))
        choice = materialize(best.join(further, "to").select("node", "label"), "choices")
        ours = now.join(choice.select(F.col("node").alias("u"), F.col("label").alias("a")), "u")
        both = ours.join(choice.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
        after = materialize(both.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        remove(now)
        rounds.append(choice)
        now = after
    if len(rounds) == 1 and left:
        return rounds[0].select("node", F.col("label").alias("component"))  # the smallest nodes already
    # the first round names every node
    *later, roots = (choice.select("node", F.col("label").alias("root")) for choice in rounds)
    for i, choice in enumerate(reversed(later)):
        known = roots.select(F.col("node").alias("via"), F.col("root").alias("end"))
        roots = choice.join(known, F.col("root") == F.col("via"), "left").select("node", F.coalesce("end", "root").alias("root"))
        if i % 6 == 5:  # short plans
            roots = materialize(roots, "roots")
    # written first: a join on the aggregation's own partitioning could not be split for a large component
    smallest = materialize(roots.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    out = materialize(roots.join(smallest, "root").select("node", "component"), "components")
    remove(smallest, *rounds)
    return out


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label): every node of a small edge table and the smallest node that it reaches."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in (u, v):
                above.setdefault(x, x)
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "label"])
