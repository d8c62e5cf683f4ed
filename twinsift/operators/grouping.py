"""Greedy grouping of similarity pairs (i < j).

A row leads a group when no earlier row that it matches leads one: the lexicographically first maximal independent set.
A leader's group is itself and all later rows that it matches; rows may be in several groups, leaders in one only.

Rounds decide it in parallel: rows without an undecided earlier match lead, their later matches are covered, both leave
with their pairs. Each round is one written table of rows with a status and one of the pairs left. What is left is
walked by one task as soon as it is WALK pairs or fewer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsift.storage import cut

#: Pairs that one task may walk at the end.
WALK = 2_000_000


def _walk(frames):
    held = list(frames)
    if not held:
        return
    edges = pd.concat(held)
    later: dict[int, list[int]] = {}
    for i, j in zip(edges.i, edges.j, strict=True):
        later.setdefault(i, []).append(j)
    covered, led = set(), []
    for x in sorted({*edges.i, *edges.j}):
        if x not in covered:
            led.append(x)
            covered.update(later.get(x, ()))
    yield pd.DataFrame({"id": led})


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("i").alias("id")).union(edges.select(F.col("j").alias("id")))


def leaders(pairs: DataFrame) -> DataFrame:
    """leader: every row that leads a group of two or more."""
    first = edges = cut(pairs.select("i", "j").distinct())
    led = None
    while edges.count() > WALK:
        later = edges.select(F.col("i").alias("id"), F.lit(False).alias("later")).union(edges.select(F.col("j").alias("id"), F.lit(True).alias("later")))
        rows = later.groupBy("id").agg(F.max("later").alias("later"))
        covered = edges.join(rows.where("NOT later").select(F.col("id").alias("i")), "i", "left_semi").select(F.col("j").alias("id")).distinct()
        rows = rows.join(covered.withColumn("covered", F.lit(True)), "id", "left")
        rows = cut(rows.select("id", F.when(~F.col("later"), "leads").when(F.col("covered"), "covered").otherwise("open").alias("status")))
        open_ = rows.where("status = 'open'").select("id")
        edges = cut(edges.join(open_.withColumnRenamed("id", "i"), "i", "left_semi").join(open_.withColumnRenamed("id", "j"), "j", "left_semi"))
        # an open row that keeps no pair has lost its earlier matches and leads
        new = rows.where("status = 'leads'").select("id").unionAll(open_.join(_ends(edges), "id", "left_anti"))
        led = new if led is None else led.unionAll(new)
    rest = edges.coalesce(1).mapInPandas(_walk, "id long")
    led = rest if led is None else led.unionAll(rest)
    return led.withColumnRenamed("id", "leader").join(first.select(F.col("i").alias("leader")), "leader", "left_semi")


def groups(pairs: DataFrame, led: DataFrame | None = None) -> DataFrame:
    """leader, pos and member: the leader at pos 0, then its later matches in order."""
    pairs = cut(pairs.select("i", "j").distinct())
    led = cut(leaders(pairs)) if led is None else led
    members = pairs.select(F.col("i").alias("leader"), F.col("j").alias("member")).join(led, "leader", "left_semi")
    pos = F.row_number().over(Window.partitionBy("leader").orderBy("member")).cast("long")
    return members.select("leader", pos.alias("pos"), "member").unionAll(led.select("leader", F.lit(0).cast("long"), F.col("leader").alias("member")))


def marked(grouped: DataFrame) -> DataFrame:
    """Every row that is in a group."""
    return grouped.select(F.col("member").alias("idx")).distinct()
