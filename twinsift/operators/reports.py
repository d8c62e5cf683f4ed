"""Reports over pairs, groups and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions import vectors


def match_report(pairs: DataFrame) -> DataFrame:
    """i, n and matches: 'j:distance' of each match in order of j."""
    listed = F.array_sort(F.collect_list(F.struct("j", "dist")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["j"].cast("string"), F.lit(":"), F.format_string("%.4f", x["dist"]))), ",")
    return pairs.groupBy("i").agg(F.count("*").alias("n"), text.alias("matches"))


def match_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("i").agg(F.count("*").alias("n"))


def dedupe_summary(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """processed, duplicates (distinct members, kept ones included) and groups."""
    g = grouped.agg(F.count_distinct("member").alias("duplicates"), F.count_distinct("leader").alias("groups"))
    return rows.agg(F.count("*").alias("processed")).join(g)


def import_summary(incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """processed rows, matching pairs, and rows with a match."""
    return incoming.agg(F.count("*").alias("processed")).join(matches.agg(F.count("*").alias("n_pairs"), F.count_distinct("i").alias("n_images")))


def store_shape(store: DataFrame, v: str = "embedding") -> DataFrame:
    return vectors.shape(store, v)


def readable(n: float) -> str:
    """A count of bytes in binary units."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.1f} {unit}" if unit != "B" else f"{n:.0f} B"
        n /= 1024
    return ""
