"""Connected components by randomised contraction, in DataFrame joins only.

Each round orders the vertices by a fresh hash, maps every vertex to the least vertex of its closed neighbourhood and
contracts the edges along that map; the expected number of vertices falls by a constant factor a round, whatever the
shape of the graph (long chains included), so rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.llm.shared import forget, written

MAX_ROUNDS = 200


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, rep) for each vertex that has an edge to another; ``rep`` names its component.

    Self-loops, repeats and both directions may occur.  No edges give no rows.
    """
    live, labels = written(_ordered(edges), "edges"), None
    for round_no in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_no), F.col(c)).alias("h"), F.col(c).alias("id"))
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(
            both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("node"), F.least("best", rank("a"))["id"].alias("rep")),
            "hooks",
        )
        at_a, at_b = hooks.toDF("a", "ra"), hooks.toDF("b", "rb")
        then = written(_ordered(live.join(at_a, "a").join(at_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        if labels is None:
            new = hooks
        else:
            new = written(
                labels.join(hooks.toDF("rep", "next"), "rep", "left").select("node", F.coalesce("next", "rep").alias("rep")), "labels"
            )
            forget(hooks)
            forget(labels)
        forget(live)
        live, labels = then, new
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("rep"))
    return labels
