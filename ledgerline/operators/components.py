"""Connected components of many graphs at once, by contraction.

In each round every node points at that node of its closed neighbourhood whose hashed key is smallest; the hash changes
with the round, so long chains shrink as fast as dense graphs.  Edges are moved to the pointed-at nodes and fall away when both
ends meet.  Rounds are written tables, so a lost executor costs a re-read; the driver only asks whether edges are left.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored


def _priority(step: int, by: list, node: Column) -> Column:
    # The node itself decides between equal hashes.
    return F.struct(F.xxhash64(F.lit(step), *by, node), node.alias("node"))


def components(edges: DataFrame, by: list) -> DataFrame:
    """`by` columns, node, label for every node of an edge (`by`, a, b): the smallest node that is connected with it.

    Nodes are of any type that has an order; graphs with different `by` values are apart.  Nodes without edges are not listed."""
    turned = edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    left = stored(edges.select(*by, "a", "b").unionByName(turned).filter("a <> b").distinct(), "edges")
    moves, step = [], 0
    while left.limit(1).count():
        best = F.min(_priority(step, by, F.col("b"))).alias("near")
        move = left.groupBy(*by, "a").agg(best).select(
            *by, F.col("a").alias("node"), F.least(F.col("near"), _priority(step, by, F.col("a")))["node"].alias("to"))
        move = stored(move, "moves")
        moves.append(move)
        a, b = (move.withColumnsRenamed({"node": end, "to": f"to_{end}"}) for end in ("a", "b"))
        left = left.join(a, [*by, "a"]).join(b, [*by, "b"]).filter("to_a <> to_b").select(
            *by, F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
        left, step = stored(left, "edges"), step + 1
    if not moves:
        return edges.select(*by, F.col("a").alias("node"), F.col("a").alias("label")).filter("node is not null").limit(0)

    def through(roots: DataFrame, move: DataFrame) -> DataFrame:
        """Roots of a round's nodes from the roots of the next round's."""
        ends = roots.withColumnsRenamed({"node": "to", "root": "next"})
        return stored(move.join(ends, [*by, "to"], "left").select(*by, "node", F.coalesce("next", "to").alias("root")), "roots")

    last = moves[-1].withColumnRenamed("to", "root")
    roots = reduce(through, moves[-2::-1], last)
    # A component's root is one of its nodes; its smallest node names it.
    names = roots.groupBy(*by, "root").agg(F.min(F.least("node", "root")).alias("label"))
    return roots.join(names, [*by, "root"]).select(*by, "node", "label")
