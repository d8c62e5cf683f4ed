"""Which member of a group to keep, and what to do with the others.

grouped is leader, pos, member; manifest is idx, rel_path, mtime, size_bytes, width, height, format. A policy is the value
whose maximum is kept, so one aggregate with map-side combine decides every group.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsift.functions.paths import is_wallpaper, source_score, trash_path
from twinsift.storage import cut

Policy = Callable[[], Column]

#: Rows of groups that one task may walk, and the share of the open rows that a round must settle for another one to follow.
WALK = 2_000_000
LEAST = 0.125


def newest() -> Column:
    """The latest; of equals the first of the group."""
    return F.struct(F.col("mtime"), -F.col("pos"))


def largest() -> Column:
    """The largest file; of equals the first of the group."""
    return F.struct(F.col("size_bytes"), -F.col("pos"))


def highest_quality() -> Column:
    """Most pixels, PNG before others, latest, last path; an unreadable file scores lowest."""
    pixels = F.coalesce(F.col("width") * F.col("height"), F.lit(0))
    known = F.col("width").isNotNull()
    return F.struct(pixels, F.when(known & (F.col("format") == "PNG"), 1).otherwise(0), F.when(known, F.col("mtime")), F.col("rel_path"))


def source_preference() -> Column:
    """Files in wallpaper folders first, then the better source; of equals the first of the group."""
    return F.struct(is_wallpaper(F.col("rel_path")), source_score(F.col("rel_path")), -F.col("pos"))


POLICIES: dict[str, Policy] = {"newest": newest, "largest": largest, "highest-quality": highest_quality, "pic-dir": source_preference}


def policy(name: str) -> Policy:
    if name.lower() not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; there are {', '.join(POLICIES)}")
    return POLICIES[name.lower()]


def _described(grouped: DataFrame, manifest: DataFrame) -> DataFrame:
    return grouped.join(manifest.withColumnRenamed("idx", "member"), "member")


def keepers(grouped: DataFrame, manifest: DataFrame, name: str = "largest") -> DataFrame:
    """leader, keep (idx) and keep_path of each group."""
    best = _described(grouped, manifest).groupBy("leader").agg(F.max_by(F.struct("member", "rel_path"), policy(name)()).alias("k"))
    return best.select("leader", F.col("k.member").alias("keep"), F.col("k.rel_path").alias("keep_path"))


def decisions(grouped: DataFrame, manifest: DataFrame, name: str = "largest", trash_dir: str = "trash") -> DataFrame:
    """leader, rel_path, keep_path and target of each member that goes. Nothing is touched."""
    kept = keepers(grouped, manifest, name)
    rows = _described(grouped, manifest).select("leader", "member", "rel_path").join(kept, "leader").where("member <> keep")
    return rows.select("leader", "rel_path", "keep_path", trash_path(trash_dir, F.col("rel_path")).alias("target"))


def _walk(protect_keepers: bool):
    """Of rows in order of leader and r: those that are kept, and those that go."""

    def run(batches):
        now, decided, gone, kept = None, False, set(), set()
        for batch in batches:
            out = []
            for leader, member, known, safe in zip(*(batch.column(c).to_pylist() for c in ("leader", "member", "known", "safe")), strict=True):
                if leader != now:
                    now, decided = leader, known
                if member in gone:
                    continue
                if not decided:
                    decided = True
                    kept.add(member)
                    out.append((leader, member, True))
                elif not (protect_keepers and (safe or member in kept)):
                    gone.add(member)
                    out.append((leader, member, False))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["leader", "member", "kept"])

    return run


def _round(open_: DataFrame, protect_keepers: bool) -> tuple[DataFrame, DataFrame]:
    """What can be settled at once, and the rows still open.

    A member is there in the first open group that it is in. The best of a group is kept if it is there; who is there goes if the
    group has decided or one better is there.
    """
    first = open_.groupBy("member").agg(F.min("leader").alias("first"))
    rows = open_.join(first, "member").withColumn("here", F.col("leader") == F.col("first"))
    best = rows.groupBy("leader").agg(F.min("r").alias("top"), F.min(F.when(F.col("here"), F.col("r"))).alias("sure"))
    rows = rows.join(best, "leader")
    keeps = F.col("here") & ~F.col("known") & (F.col("r") == F.col("top"))
    beaten = F.col("here") & (F.col("known") | (F.col("r") > F.col("sure")))
    goes = F.when(F.col("safe"), "passed").otherwise("moved") if protect_keepers else F.lit("moved")
    rows = cut(rows.select("leader", "member", "r", "known", "safe", F.when(keeps, "kept").when(beaten, goes).otherwise("open").alias("status")))
    kept, moved = rows.where("status = 'kept'"), rows.where("status = 'moved'")
    left = rows.where("status = 'open'").join(moved.select("member"), "member", "left_anti")
    left = left.join(kept.select("leader", F.lit(True).alias("now_known")), "leader", "left")
    left = left.join(kept.select("member").distinct().withColumn("now_safe", F.lit(True)), "member", "left")
    left = left.select("leader", "member", "r", (F.col("known") | F.col("now_known").isNotNull()).alias("known"), (F.col("safe") | F.col("now_safe").isNotNull()).alias("safe"))
    settled = kept.unionAll(moved).select("leader", "member", (F.col("status") == "kept").alias("kept"))
    return settled, cut(left)


def live_decisions(grouped: DataFrame, manifest: DataFrame, name: str = "largest", trash_dir: str = "trash", protect_keepers: bool = False) -> DataFrame:
    """decisions() with groups taken in order of their leaders: what an earlier group moved is no member of a later one, and
    with protect_keepers what an earlier group kept is never moved.

    Rounds settle what can be decided in parallel until WALK rows or fewer are open, or a round settles too few: groups can
    hang together in chains of any length. One task walks the rest in order, and holds the members that it has moved or kept only.
    """
    order = Window.partitionBy("leader").orderBy(policy(name)().desc(), "member")
    rows = cut(_described(grouped, manifest).select("leader", "member", "rel_path", F.row_number().over(order).alias("r")))
    open_, settled = rows.select("leader", "member", "r", F.lit(False).alias("known"), F.lit(False).alias("safe")), None
    n, before = rows.count(), None
    while n > WALK and (before is None or before - n >= LEAST * before):
        now, open_ = _round(open_, protect_keepers)
        settled = now if settled is None else settled.unionAll(now)
        n, before = open_.count(), n
    walked = open_.repartition(1).sortWithinPartitions("leader", "r").mapInArrow(_walk(protect_keepers), "leader long, member long, kept boolean")
    settled = cut(walked if settled is None else settled.unionAll(walked)).join(rows.select("leader", "member", "rel_path"), ["leader", "member"])
    kept = settled.where("kept").select("leader", F.col("rel_path").alias("keep_path"))
    return settled.where("NOT kept").join(kept, "leader").select("leader", "rel_path", "keep_path", trash_path(trash_dir, F.col("rel_path")).alias("target"))
