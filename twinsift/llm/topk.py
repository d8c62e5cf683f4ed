"""Exact top-k search by inner product over norm-sorted blocks.

Candidates are numbered by descending length; each BLOCK of them is one row. A block rotates its vectors by the
right singular vectors of its own matrix, so that the first PARTIAL coordinates carry most of every product, and keeps
the length of what is left. Queries come in groups of QUERIES. For a query and a candidate, the partial product plus
the product of the two residual lengths bounds the score (Cauchy-Schwarz); what lies below the query's k-th best score
so far is pruned, and a query leaves the block once its length times that of the next candidates does. Survivors are
scored exactly in integers. The block of the longest vectors goes first and gives every query a threshold; each query group
then meets the blocks, from the first on, that are long enough for one of its queries. Vectors are packed in the
narrowest integers that hold them.

Scores are exact at any size: products are formed in doubles where the largest possible one stays below 2**53, in 64-bit
integers below 2**63, and in Python's integers beyond. A component or a returned score that needs more than 64 bits is an error.

Defined results: vectors null, empty, or holding a null or non-finite component take no part. Vectors of another
dimension than the query's are no candidates for it. Equal scores go to the smaller vec_id; of repeated rows each is a candidate.
A query skips all rows of its own id; several rows of a query's id ask once, with the smallest vector. Texts don't occur.
Extra columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsift.llm.shared import cut, drop_cut

NAME = "op7_exact_top_k"

K = 20
BLOCK = 4096
QUERIES = 2048
TILE = 1024
PARTIAL = 16
_LEAST = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the components times scale, rounded down, of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < F.lit(2.0**63), F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component needs more than 64 bits")).cast("long"))

    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def _pack(m: np.ndarray) -> tuple[bytes, int]:
    """The numbers in the narrowest integers that hold them, and the bytes of each."""
    for t in (np.int8, np.int16, np.int32):
        if len(m) and m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max:
            return m.astype(t).tobytes(), np.dtype(t).itemsize
    return m.tobytes(), 8


def _matrix(raw: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{width}").astype(np.int64).reshape(-1, dim)


def _sizes(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


_PACKED = "block long, dim int, ids binary, m binary, width int, norm double"


def _packed(key, table):
    """The vectors of a group as one row for each dimension."""
    v = table.column("v").combine_chunks()
    ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
    dims = v.value_lengths().to_numpy(zero_copy_only=False)
    flat, owner = v.flatten().to_numpy(zero_copy_only=False), np.repeat(dims, dims)
    out = []
    for dim in np.unique(dims).tolist():
        m = flat[owner == dim].reshape(-1, dim)
        raw, width = _pack(m)
        out.append((key[0].as_py(), dim, ids[dims == dim].astype(np.int64).tobytes(), raw, width, float(_sizes(m).max())))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.float64())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "dim", "ids", "m", "width", "norm"), zip(*out, strict=True), kinds, strict=True)})


def _wide(score: np.ndarray) -> np.ndarray:
    """Python's integers as 64-bit ones."""
    if score.size and (score.max() >= 2**63 or score.min() < -(2**63)):
        raise OverflowError("a score needs more than 64 bits")
    return score.astype(np.int64)


def search(qids, q, ids, c, least, known, k=K):
    """Query numbers, candidate ids and scores: the k best of this block for each query, none below `least` where one is known."""
    size = _sizes(c)
    order = np.lexsort((ids, -size))
    c, ids, size = c[order], ids[order], size[order]
    fq, fc = q.astype(np.float64), c.astype(np.float64)
    most = int(np.abs(fq).max()) * int(np.abs(fc).max()) * q.shape[1] if q.size and c.size else 0
    if most >= 2**63:
        wq, wc = q.astype(object), c.astype(object)
    p = min(PARTIAL, q.shape[1])
    turn = np.linalg.eigh(fc.T @ fc)[1][:, ::-1]
    rq, rc = fq @ turn, fc @ turn
    tail = lambda m: np.sqrt((m[:, p:] ** 2).sum(axis=1))
    tq, tc, qsize = tail(rq), tail(rc), _sizes(q)
    slack = 1e-6 * (1 + qsize * size[0])
    best, names, held = np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), bool)
    floor = np.where(known, least.astype(np.float64), -np.inf)
    active = np.arange(len(q))
    for at in range(0, len(c), TILE):
        # the rest is no longer than this tile's first
        active = active[qsize[active] * size[at] + slack[active] >= floor[active]]
        if not len(active):
            break
        to = slice(at, at + TILE)
        bound = rq[active, :p] @ rc[to, :p].T
        bound += tq[active][:, None] * tc[to][None, :]
        open_ = bound + slack[active][:, None] >= floor[active][:, None]
        some = np.flatnonzero(open_.any(axis=1))
        if not len(some):
            continue
        rows, keep = active[some], open_[some]
        if most < 2**53 and keep.mean() > 0.05:
            score = np.rint(fq[rows] @ fc[to].T).astype(np.int64)
        else:
            a, b = np.nonzero(keep)
            score = np.zeros(keep.shape, np.int64)
            score[a, b] = (q[rows[a]] * c[at + b]).sum(axis=1) if most < 2**63 else _wide((wq[rows[a]] * wc[at + b]).sum(axis=1))
        keep &= (~known[rows][:, None] | (score >= least[rows][:, None])) & (qids[rows][:, None] != ids[to][None, :])
        score = np.concatenate([best[rows], score], axis=1)
        keep = np.concatenate([held[rows], keep], axis=1)
        name = np.concatenate([names[rows], np.broadcast_to(ids[to], (len(rows), len(ids[to])))], axis=1)
        # the k-th best score, then of the candidates that reach it the first k, ties by id
        kth = np.partition(np.where(keep, score, _LEAST), score.shape[1] - k, axis=1)[:, -k]
        a, b = np.nonzero(keep & (score >= kth[:, None]))
        s, n = score[a, b], name[a, b]
        sort = np.lexsort((n, ~s, a))
        a, s, n = a[sort], s[sort], n[sort]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        first = place < k
        a, s, n, place = a[first], s[first], n[first], place[first]
        held[rows] = False
        best[rows[a], place], names[rows[a], place], held[rows[a], place] = s, n, True
        full = np.flatnonzero(held[rows].all(axis=1))
        floor[rows[full]] = np.maximum(floor[rows[full]], best[rows[full], k - 1].astype(np.float64))
    a, b = np.nonzero(held)
    return a, names[a, b], best[a, b]


def _run(k: int):
    def run(frames):
        for f in frames:
            for row in f.to_pylist():
                q, c = _matrix(row["qm"], row["qwidth"], row["dim"]), _matrix(row["m"], row["width"], row["dim"])
                qids, ids = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
                least = np.frombuffer(row["least"], np.int64) if row["least"] is not None else np.zeros(len(qids), np.int64)
                known = np.frombuffer(row["known"], bool) if row["known"] is not None else np.zeros(len(qids), bool)
                a, b, s = search(qids, q, ids, c, least, known, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _thresholds(key, groups, found):
    """A query group with the k-th best score of each query so far, and the length that a candidate needs to matter."""
    out = []
    got: dict[int, int] = dict(zip(found.column("query_id").to_pylist(), found.column("least").to_pylist(), strict=True))
    for row in groups.to_pylist():
        ids = np.frombuffer(row["qids"], np.int64)
        size = _sizes(_matrix(row["qm"], row["qwidth"], row["dim"]))
        known = np.array([int(i) in got for i in ids], bool)
        least = np.array([got.get(int(i), 0) for i in ids], np.int64)
        need = np.where(known & (least > 0), least / np.maximum(size, 1e-9), 0.0)
        out.append((row["q"], row["qids"], row["qm"], row["qwidth"], row["dim"], least.tobytes(), known.tobytes(), float(need.min()) * (1 - 1e-9)))
    cols = list(zip(*out, strict=True)) or [[]] * 8
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("q", "qids", "qm", "qwidth", "dim", "least", "known", "need"), cols, kinds, strict=True)})


def _by_length(vectors: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """vectors with block: BLOCK of them each, numbered by descending length; and the cut table that they are read from. Only the
    count of each range reaches the driver."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dealt = vectors.withColumn("norm2", norm).repartitionByRange(max(1, -(-n // BLOCK)), F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    # the low 33 bits of the id count within a range, the others name it
    dealt = cut(dealt.select("vec_id", "v", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    starts, total = [], 0
    for r in dealt.groupBy(part.alias("_part")).count().orderBy("_part").collect():
        starts.append((r["_part"], total))
        total += r["count"]
    start = F.broadcast(vectors.sparkSession.createDataFrame(starts, "_part long, _start long"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(start, "_part").select("vec_id", "v", F.floor(place / BLOCK).alias("block")), dealt


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score; vectors and queries as whole_vectors() gives them."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = vectors.count(), queries.count()
    schema = "query_id long, vec_id long, score long"
    numbered, ranged = _by_length(vectors, n)
    blocks = cut(numbered.groupBy("block").applyInArrow(_packed, _PACKED))
    drop_cut(ranged)
    n_groups = max(1, -(-m // QUERIES))
    dealt = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).alias("block"), "vec_id", "v")
    groups = cut(dealt.groupBy("block").applyInArrow(_packed, _PACKED).select(F.col("block").alias("q"), F.col("ids").alias("qids"), F.col("m").alias("qm"), F.col("width").alias("qwidth"), "dim"))
    # a row for each block, without its vectors: the blocks of a dimension, longest first
    index = blocks.select("dim", "block", "norm")
    ends = index.groupBy("dim").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    names = ["qids", "qm", "qwidth", "dim", "ids", "m", "width", "least", "known"]
    no = F.lit(None).cast("binary")
    start = groups.join(ends, "dim").withColumn("block", F.col("first")).join(blocks, ["dim", "block"]).withColumns({"least": no, "known": no}).repartition("q")
    head = cut(start.select(*names).mapInArrow(_run(k), schema))
    kth = head.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    kth = kth.select(F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("q"), "query_id", "least")
    state = "q long, qids binary, qm binary, qwidth int, dim int, least binary, known binary, need double"
    ready = cut(groups.groupBy("q").cogroup(kth.groupBy("q")).applyInArrow(_thresholds, state))
    drop_cut(groups)
    # each group names the blocks that it has left, and keeps those that are long enough
    left = ready.join(ends.where("first < last"), "dim").select("dim", "q", "need", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("block"))
    pairs = left.join(index, ["dim", "block"]).where("norm >= need").select("dim", "block", "q")
    more = pairs.join(blocks, ["dim", "block"]).join(ready, ["dim", "q"]).repartition("q", "block").select(*names).mapInArrow(_run(k), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return head.unionAll(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
