"""Connected components by contraction, in DataFrame functions only.

Each round gives every node of the remaining edges the neighbour (or itself) that ranks first, then replaces both ends
of each edge by that choice and drops loops and repeats. The first rounds rank by id, which ends stars around their
smallest id at once; later ones rank by a hash of the round, so that a constant share of the nodes goes in each
whatever the ids look like (long chains too). Hubs are met by partial aggregation, and every round is a written table. Nothing is collected. The choices are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.shared import cut, drop_cut


#: Rounds that rank by id.
BY_ID = 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: each node of the edges with the smallest node that it reaches. Edges with a null end are
    dropped, and so are loops, whose node has no row unless another edge holds it."""
    left = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps, n = [], 0
    while not left.isEmpty():
        n += 1
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct((F.lit(0).cast("long") if n <= BY_ID else F.xxhash64(F.col(c), F.lit(n))).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        best = both.groupBy(F.col("u").alias("node")).agg(F.min(rank("v")).alias("m"))
        chosen = cut(best.select("node", F.when(F.col("m") < rank("node"), F.col("m.id")).otherwise(F.col("node")).alias("to")))
        maps.append(chosen)
        x, y = chosen.select(F.col("node").alias("u"), F.col("to").alias("cu")), chosen.select(F.col("node").alias("v"), F.col("to").alias("cv"))
        moved = left.join(x, "u").join(y, "v").where("cu <> cv")
        smaller = cut(moved.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
        drop_cut(left)
        left = smaller
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    end = maps[0]
    for later in maps[1:]:
        nxt = later.select(F.col("node").alias("to"), F.col("to").alias("then"))
        end = end.join(nxt, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    end = cut(end)
    drop_cut(left, *maps)
    least = end.groupBy("to").agg(F.min("node").alias("component"))
    return end.join(least, "to").select("node", "component")
