"""Line dedup by pairwise alignment.

Overlapping documents are found through the hashes of windows that they share. A window is a run of neighbouring lines
that just reaches MIN_CHARS from its first line on, or from its last line back; every line of a longer run lies in a window
inside the run, and the same run has the same windows in any document. A window held by several documents links each later
one to the first that holds it: one link a document, not all pairs, so that a frequent window costs no more than a rare one
and none is dropped. Links get a rarity, the sum of 1 / documents over their shared windows. Each linked pair is aligned with patience diff: lines that both hold
once are matched in the longest order-preserving way, matches grow over equal neighbours, and the stretches between
are aligned in the same way. Lines that repeat or have moved have no such match; what is left of the later document is
aligned by its windows, each with any place of the other that holds it, until no block of MIN_CHARS is left. Aligned blocks
of MIN_CHARS characters or more are deleted from the later document: in all, every line that lies in a run of MIN_CHARS
characters that an earlier document holds, in whatever order and however often.

Lines are split at \\n and compared whole, by a 64-bit hash; a line of white space matches within a block but
links nothing. Alignments are judged on the input, not on what is left.

Defined results: null and empty texts have no line to delete and stay as they are. Rows without id, and rows of one id,
aren't linked with each other. Lines repeated within a document that no earlier one holds are kept. Very long texts are
aligned whole, by numbers that stand for their lines. Of equally long alignments patience diff takes the one that is first
from its end back; what goes in the end is the same for each. Extra columns pass through; cleaned() keeps any names apart, and dedup_lines()
puts its own columns in the place of those with their names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import textkit as T
from twinsift.llm.shared import cut, salted

NAME = "op5_line_dedup"
MIN_CHARS = 50
#: Later documents of one first document that a task aligns.
PARTNERS = 2048
#: Holders of one window that a task joins with its first.
HOLDERS = 4096


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, in order of the first, whose seconds rise; of equally long ones the one that is, from
    its last pair back, first."""
    piles: list[list[int]] = []
    tails: list[int] = []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        if n == len(tails):
            tails.append(y)
            piles.append([k])
        else:
            tails[n] = y
            piles[n].append(k)
    out: list[tuple[int, int]] = []
    for pile in reversed(piles):
        # seconds fall along a pile: the first that is below the pair found last
        at = bisect_left(pile, True, key=lambda k: not out or pairs[k][1] < out[-1][1])
        out.append(pairs[pile[at]])
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Matched blocks (start in a, start in b, length), in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        one: dict[int, int] = {}
        for x in range(i, j):
            one[a[x]] = -1 if a[x] in one else x
        two: dict[int, int] = {}
        for y in range(k, m):
            two[b[y]] = -1 if b[y] in two else y
        anchors = _rising([(x, two[h]) for h, x in one.items() if x >= 0 and two.get(h, -1) >= 0])
        found += anchors
        if anchors:
            edges = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(x + 1, to_x, y + 1, to_y) for (x, y), (to_x, to_y) in zip(edges, edges[1:], strict=False)]
    blocks: list[tuple[int, int, int]] = []
    for x, y in sorted(found):
        if blocks and blocks[-1][0] + blocks[-1][2] == x and blocks[-1][1] + blocks[-1][2] == y:
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
        else:
            blocks.append((x, y, 1))
    return blocks


def windows(hs: np.ndarray, lens: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the windows of documents whose lines begin at off (one more entry at the end)."""
    n, least = len(lens), max(min_chars, 1)
    chars = np.zeros(n + 1, np.int64)
    np.cumsum(lens, out=chars[1:])
    size = np.diff(off)
    at, first, end = np.arange(n), np.repeat(off[:-1], size), np.repeat(off[1:], size)
    to = np.searchsorted(chars, chars[:-1] + least, "left")
    since = np.searchsorted(chars, chars[1:] - least, "right") - 1
    # a window that is the shortest from both sides counts once
    down, up = to <= end, (since >= first) & (to[since] != at + 1)
    starts, ends = np.concatenate([at[down], since[up]]), np.concatenate([to[down], at[up] + 1])
    return starts, ends, T.runs(hs.astype(np.uint64), starts, ends)


def aligned(other: np.ndarray, sizes: np.ndarray, hs: np.ndarray, lens: np.ndarray, min_chars: int) -> list[tuple[int, int]]:
    """Line ranges [from, to) of the later document (hs, lens) that align with the other in blocks of min_chars."""
    gone = np.zeros(len(hs), bool)
    for _, y, n in patience(other.tolist(), hs.tolist()):
        if lens[y : y + n].sum() >= min_chars:
            gone[y : y + n] = True
    if not np.isin(hs[~gone], other).any():
        return _ranges(gone)
    # repeated or moved: what is left aligns wherever a window of it occurs in the other
    n = len(other)
    starts, ends, h = windows(np.concatenate([other, hs]), np.concatenate([sizes, lens]), np.array([0, n, n + len(hs)]), min_chars)
    mine = starts >= n
    hit = mine.copy()
    hit[mine] = np.isin(h[mine], h[~mine])
    depth = np.bincount(starts[hit] - n, minlength=len(hs) + 1) - np.bincount(ends[hit] - n, minlength=len(hs) + 1)
    return _ranges(gone | (np.cumsum(depth)[:-1] > 0))


def _ranges(gone: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, hs and lens: a hash and the characters of each line; blank lines have length 0."""
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n", -1).alias("l"))
    return d.select("doc_id", F.transform("l", lambda x: F.xxhash64(x)).alias("hs"), F.transform("l", lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.length(x)).otherwise(0)).alias("lens"))


def overlaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, first and rarity: the earlier documents that each document shares windows with."""

    def run(batches):
        for f in batches:
            lines = f.column("hs")
            off = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            starts, _, h = windows(lines.flatten().to_numpy(), f.column("lens").flatten().to_numpy(), off, min_chars)
            ids = f.column("doc_id").to_numpy()[np.searchsorted(off, starts, "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64))], ["doc_id", "h"])

    # a row for each document and window
    each = _lines(docs).mapInArrow(run, "doc_id long, h long").distinct()
    held = each.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("df")).where("df > 1")
    # a window that many documents hold is dealt over several tasks, HOLDERS rows each; such windows are few
    salts = F.ceil(F.col("df") / HOLDERS).cast("int")
    hot = held.where(F.col("df") > HOLDERS).select("h", salts.alias("salts"))
    mine = salted(each, hot, "h", "doc_id").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"), F.lit(0)))
    dealt = held.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    hits = mine.join(dealt, ["h", "salt"]).where("doc_id > first")
    return hits.groupBy("doc_id", "first").agg(F.sum(1 / F.col("df")).alias("rarity"))


def blocks(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, first, rarity and spans: line ranges [from, to) of the later document that align with the first.

    A first document with many later ones is dealt over several tasks, PARTNERS of them each.
    """
    lines = _lines(docs)
    links = cut(overlaps(docs, min_chars))
    hubs = links.groupBy("first").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")).where("salts > 1")
    held = lines.select(F.col("doc_id").alias("first"), F.col("hs").alias("other"), F.col("lens").alias("sizes")).join(hubs, "first", "left")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    mine = salted(links, hubs, "first", "doc_id").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"), F.lit(0))).join(lines, "doc_id")
    both = mine.join(held, ["first", "salt"])

    def run(frames):
        for f in frames:
            out = []
            for d, first, rarity, hs, lens, other, sizes in zip(f.doc_id, f["first"], f.rarity, f.hs, f.lens, f.other, f.sizes, strict=True):
                spans = aligned(other, sizes, hs, lens, min_chars)
                if spans:
                    out.append((d, first, rarity, spans))
            yield pd.DataFrame(out, columns=["doc_id", "first", "rarity", "spans"])

    return both.select("doc_id", "first", "rarity", "hs", "lens", "other", "sizes").mapInPandas(run, "doc_id long, first long, rarity double, spans array<struct<`from`:int,`to`:int>>")


def cleaned(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """row, a struct of docs' columns with the aligned blocks deleted from text, and n_lines, n_removed and n_partners."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), F.col("doc_id").cast("long").alias("_id"))
    marks = blocks(docs.select("doc_id", "text"), min_chars).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.count("*").alias("_n"))
    d = own.join(marks.withColumnRenamed("doc_id", "_id"), "_id", "left")
    none = F.array().cast("array<int>")
    gone = F.array_distinct(F.flatten(F.transform("_spans", lambda x: F.sequence(x["from"], x["to"] - 1))))
    text = F.col("_own.text")
    d = d.select("_own", text.alias("_text"), F.split(text, "\n", -1).alias("_lines"), F.coalesce(gone, none).alias("_gone"), "_n")
    # by places: the lines are looked at once, however many go
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    new = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    row = F.struct(*[new.alias(c) if c == "text" else F.col(f"_own.`{c}`").alias(c) for c in docs.columns])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return d.select(row.alias("row"), count(F.size("_lines")).alias("n_lines"), count(F.size("_gone")).alias("n_removed"), count(F.col("_n")).alias("n_partners"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the aligned blocks deleted from text, and with n_lines, n_removed and n_partners, which replace columns of
    these names."""
    stats = ["n_lines", "n_removed", "n_partners"]
    return cleaned(docs, min_chars).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in stats], *stats)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_partners", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_CHARS = r"CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN length(x) ELSE 0 END"
SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
one AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT doc_id, i, sum({_CHARS}) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM one),
p AS (SELECT doc_id, i, c, coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY i), 0) AS b FROM c),
ends AS (SELECT doc_id, c, min(i) AS t FROM p GROUP BY ALL), heads AS (SELECT doc_id, b, max(i) AS s FROM p GROUP BY ALL),
w AS (SELECT p.doc_id, p.i AS s, e.t FROM p ASOF JOIN ends e ON p.doc_id = e.doc_id AND p.b + {MIN_CHARS} <= e.c
  UNION SELECT p.doc_id, h.s, p.i FROM p ASOF JOIN heads h ON p.doc_id = h.doc_id AND p.c - {MIN_CHARS} >= h.b),
run AS (SELECT w.doc_id, s, t, array_to_string(list_slice(ls, s, t), chr(10)) AS x FROM w JOIN d USING (doc_id)),
hit AS (SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY x) AS first FROM run) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, t)) AS i FROM hit),
g AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT first) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(q.n, 0)::BIGINT AS n_partners,
  sha256(CASE WHEN g.n IS NULL THEN coalesce(text, '') ELSE array_to_string([y FOR y, i IN ls IF NOT list_contains(gone, i)], chr(10)) END) AS text_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN q USING (doc_id)
"""
