"""Euclidean similarity joins: within one set, between two sets, and the full matrix.

Inputs hold idx (long) and v (array of doubles). Strategies, all exact:

- nested: a nested-loop join over array functions; the reference for the others, for small inputs.
- blocked: rows are dealt to blocks, a block is one row of packed numbers, each pair of blocks is one group, and a matrix
  product finds the candidates in it. Blocks are as large as BLOCK_BYTES allows, since every block is sent to every other.
- grid: vectors whose distance is at most t differ by at most t along every unit direction. Slabs of equal rows along a few
  directions cross in cells, a cell is one block or several, and only blocks of cells in reach of each other are paired and
  multiplied. The smaller t against the spread, the fewer pairs; the more rows, the narrower the slabs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.vectors import MixedDimensionsError, l2, near_pairs, within
from twinsift.storage import cut

PAIRS = "i long, j long, dist double"
#: Bytes of a block's vectors, and entries of a block's matrix product that are held at a time.
BLOCK_BYTES = 16 << 20
TILE = 1 << 21
#: Rows of a block of the full matrix, parts that each side of it is dealt to, distances that are worked out at a time, and those of a
#: row that are returned in a run.
MATRIX_ROWS = 1024
MATRIX_PARTS = 256
MATRIX_TILE = 1 << 16
MATRIX_RUN = 32
RANK_ROWS = 100_000
GRID_DIRECTIONS = 3
#: Blocks from which on grid is chosen, and that it makes at least.
GRID_BLOCKS = 64


def _ranked(df: DataFrame, key: str, name: str, bucket_rows: int) -> DataFrame:
    """The distinct keys with their 0-based ranks. Keys are sorted in ranges; only a range's count reaches the driver."""
    ids = df.select(key).distinct()
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // bucket_rows))
    # the low 33 bits of the id count within a range, the others name it
    one = F.monotonically_increasing_id()
    dealt = cut(ids.repartitionByRange(n, key).sortWithinPartitions(key).select(key, one.alias("_at")))
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["count"]
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    return dealt.withColumn("_part", part).join(start, "_part").select(key, (F.col("_start") + low).alias(name))


def with_idx(df: DataFrame, key: str, v: Column) -> DataFrame:
    """idx, the 0-based rank of the key, and v."""
    return df.select(key, v.alias("v")).join(_ranked(df, key, "idx", RANK_ROWS), key)


def ranks(ids: DataFrame, bucket_rows: int = RANK_ROWS) -> DataFrame:
    """id and r, the 0-based rank of each id among the distinct ones."""
    return _ranked(ids, "id", "r", bucket_rows)


def profile(df: DataFrame) -> tuple[int, int]:
    """Rows and dimension; MixedDimensionsError where the vectors differ in length."""
    row = df.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("dim")).first()
    if row.least != row.dim and row.least is not None:
        raise MixedDimensionsError(f"vectors of {row.least} to {row.dim} components")
    return row.n, row.dim or 0


def plan(size: tuple[int, int]) -> str:
    """The strategy for a join, from its rows and dimension: grid where there are blocks enough to leave some pairs out."""
    return "grid" if size[0] * size[1] * 8 > GRID_BLOCKS * BLOCK_BYTES else "blocked"


def directions(dim: int, n: int = GRID_DIRECTIONS, seed: int = 7) -> np.ndarray:
    """n orthogonal unit vectors, the same each time."""
    m = np.random.default_rng(seed).normal(size=(dim, min(n, dim)))
    return np.linalg.qr(m)[0].T


def _along(v: Column, u: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in u]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _n_blocks(df: DataFrame, size: tuple[int, int]) -> int:
    """So many blocks that each fits its bytes and that their pairs occupy all tasks."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(int((2 * tasks) ** 0.5), -(-size[0] * size[1] * 8 // BLOCK_BYTES), 1)


def _packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ids, m and f32: the rows of each key as one block; 32-bit floats where they hold the same numbers."""
    key_type = df.select(*keys).schema

    def run(key, table):
        m = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        narrow = m.astype(np.float32)
        f32 = bool((narrow == m).all())
        ids = table.column("idx").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        cols = {"ids": pa.array([ids.tobytes()]), "m": pa.array([(narrow if f32 else m).tobytes()]), "f32": pa.array([f32])}
        return pa.table({k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=True)} | cols)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_type)
    return df.groupBy(*keys).applyInArrow(run, f"{schema}, ids binary, m binary, f32 boolean")


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """n blocks by a hash of idx; null vectors are left out."""
    return _packed(df.where("v IS NOT NULL").select("idx", "v", F.pmod(F.xxhash64("idx"), F.lit(n)).cast("int").alias("p")), ["p"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["m"], np.float32 if row["f32"] else np.float64).astype(np.float64).reshape(len(ids), -1)


def _block_pairs(sides: DataFrame, kernel) -> DataFrame:
    """kernel(ids, m, ids, m) of the two rows, side 0 and side 1, of each pair of blocks (x, y)."""

    def run(table):
        rows = {r["side"]: r for r in table.to_pylist()}
        found = kernel(*_unpacked(rows[0]), *_unpacked(rows[1])) if len(rows) == 2 else ([], [], [])
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("i", "j", "dist"), found, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return sides.groupBy("x", "y").applyInArrow(run, PAIRS)


def _tiles(a: np.ndarray, b: np.ndarray, threshold: float, f32: bool):
    """near_pairs over some rows of a at a time."""
    step = max(1, TILE // max(1, len(b)))
    got = [(k, near_pairs(a[k : k + step], b, threshold, f32)) for k in range(0, len(a), step)]
    return np.concatenate([i + k for k, (i, _, _) in got]), *(np.concatenate([x[c] for _, x in got]) for c in (1, 2))


def _blocked_self(df: DataFrame, threshold: float, f32: bool, size: tuple[int, int]) -> DataFrame:
    n = _n_blocks(df, size)
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = _dealt(df, n).withColumn("q", each)
    # a block meets itself as both sides
    side = F.explode(F.when(F.col("p") == F.col("q"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("p") > F.col("q")).cast("int"))))
    sides = blocks.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), side.alias("side"), "ids", "m", "f32")

    def kernel(ids, a, others, b):
        i, j, d = _tiles(a, b, threshold, f32)
        i, j = ids[i], others[j]
        keep = i < j if len(ids) == len(others) and (ids == others).all() else np.ones(len(i), bool)
        return np.minimum(i, j)[keep], np.maximum(i, j)[keep], d[keep]

    return _block_pairs(sides, kernel)


def _two_sides(a: DataFrame, b: DataFrame, n: int, m: int) -> DataFrame:
    left = _dealt(a, n).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(F.col("p").alias("x"), F.col("q").alias("y"), F.lit(0).alias("side"), "ids", "m", "f32")
    right = _dealt(b, m).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("q").alias("x"), F.col("p").alias("y"), F.lit(1).alias("side"), "ids", "m", "f32")
    return left.unionAll(right)


def _blocked_sets(a: DataFrame, b: DataFrame, threshold: float, f32: bool, sizes) -> DataFrame:
    def kernel(ids, x, others, y):
        i, j, d = _tiles(x, y, threshold, f32)
        return ids[i], others[j], d

    return _block_pairs(_two_sides(a, b, _n_blocks(a, sizes[0]), _n_blocks(b, sizes[1])), kernel)


def _nested(a: DataFrame, b: DataFrame, threshold: float, f32: bool, ordered: bool) -> DataFrame:
    x, y = a.select(F.col("idx").alias("i"), F.col("v").alias("a")), b.select(F.col("idx").alias("j"), F.col("v").alias("b"))
    test = within(l2(F.col("a"), F.col("b")), threshold, f32)
    both = x.join(y, (F.col("i") < F.col("j")) & test if ordered else test)
    return both.select("i", "j", l2(F.col("a"), F.col("b")).alias("dist"))


class _Slabs:
    """Slabs of equal rows along a few directions, and for each slab the slabs that a threshold reaches from it."""

    def __init__(self, df: DataFrame, dim: int, n: int, threshold: float):
        self.units = directions(dim)
        self.n = max(1, round(n ** (1 / len(self.units))))
        along = [_along(F.col("v"), u) for u in self.units]
        cuts = [F.percentile_approx(c, [k / self.n for k in range(1, self.n)], 50 * self.n) for c in along]
        row = df.where("v IS NOT NULL").agg(*[c.alias(f"c{k}") for k, c in enumerate(cuts)]).first() if self.n > 1 else [None] * len(along)
        self.cuts = [sorted(x for x in r or () if np.isfinite(x)) for r in row]
        # distances of projections are at most those of vectors, but for rounding
        reach = threshold * (1 + 1e-6) + 1e-9 * max((abs(x) for c in self.cuts for x in c), default=1.0)
        self.reach = []
        for c in self.cuts:
            low, high = [-np.inf, *c], [*c, np.inf]
            self.reach.append([[j for j in range(len(low)) if low[j] - h <= reach and lo - high[j] <= reach] for lo, h in zip(low, high, strict=True)])

    def columns(self) -> list[Column]:
        out = []
        for u, c in zip(self.units, self.cuts, strict=True):
            at = _along(F.col("v"), u)
            k = F.size(F.filter(F.array(*map(F.lit, c)).cast("array<double>"), lambda x: x < at))  # noqa: B023
            # no distance from what isn't finite
            out.append(F.when(F.isnan(at) | (F.abs(at) == float("inf")), F.lit(None).cast("int")).otherwise(k))
        return out

    def near(self, k: int) -> Column:
        """The slabs in reach of slab k<k>, a column."""
        return F.get(F.array(*[F.array(*map(F.lit, x)) for x in self.reach[k]]), F.col(f"k{k}"))


def _cells(df: DataFrame, slabs: _Slabs, dim: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the cells that slabs cross in, and the number of blocks of each cell: a full cell has several."""
    keys = [f"k{k}" for k in range(len(slabs.units))]
    rows = df.where("v IS NOT NULL").select("idx", "v", *[c.alias(k) for k, c in zip(keys, slabs.columns(), strict=True)]).dropna(subset=keys)
    most = max(1, BLOCK_BYTES // (8 * dim))
    full = cut(rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("idx"), F.col("salts")).cast("int").alias("salt")
    return cut(_packed(rows.join(full, keys).select("idx", "v", *keys, salt), [*keys, "salt"])), full


def _grid(a: DataFrame, b: DataFrame, threshold: float, f32: bool, ordered: bool, sizes) -> DataFrame:
    """Blocks of cells, each pair of blocks whose cells are in reach of each other; ordered: a joined with itself."""
    dim = sizes[1][1]
    if not dim or threshold < 0 or not sizes[0][0]:
        return _nested(a, b, threshold, f32, ordered)
    wanted = max(GRID_BLOCKS, *(-(-n * dim * 8 // BLOCK_BYTES) for n, _ in sizes))
    slabs = _Slabs(b, dim, wanted, threshold)
    blocks, full = _cells(b, slabs, dim)
    others, others_full = (blocks, full) if ordered else _cells(a, slabs, dim)
    keys = [f"k{k}" for k in range(len(slabs.units))]
    here = F.struct(*keys, "salt")

    def side(own: DataFrame, met: DataFrame, number: int) -> DataFrame:
        """A row of each block for each block of met that is in reach."""
        far = own.select(here.alias("own"), *[slabs.near(k).alias(f"k{k}") for k in range(len(keys))], "ids", "m", "f32")
        for k in keys:
            far = far.withColumn(k, F.explode(k))
        far = far.join(met, keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("far", here)
        x, y = ("own", "far") if number == 0 else ("far", "own")
        out = far.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(number).alias("side"), "ids", "m", "f32")
        return out.where("x <= y") if ordered else out

    def kernel(ids, x, rest, y):
        i, j, d = _tiles(x, y, threshold, f32)
        i, j = ids[i], rest[j]
        if not ordered:
            return i, j, d
        keep = i < j if len(ids) == len(rest) and (ids == rest).all() else np.ones(len(i), bool)
        return np.minimum(i, j)[keep], np.maximum(i, j)[keep], d[keep]

    return _block_pairs(side(others, full, 0).unionAll(side(blocks, others_full, 1)), kernel)


def self_join(df: DataFrame, threshold: float = 0.1, strategy: str = "auto", compat_index_bug: bool = False, compat_f32: bool = False) -> DataFrame:
    """i, j, dist of all pairs i < j within the threshold. Vectors of different lengths are an error.

    compat_index_bug drops the pairs whose ranks are (r, 2 r + 1), as a search that mixes up two numberings would.
    """
    size = profile(df)
    strategy = plan(size) if strategy == "auto" else strategy
    if strategy == "blocked":
        pairs = _blocked_self(df, threshold, compat_f32, size)
    elif strategy == "grid":
        pairs = _grid(df, df, threshold, compat_f32, True, (size, size))
    else:
        pairs = _nested(df, df, threshold, compat_f32, True)
    if compat_index_bug:
        place = ranks(df.select(F.col("idx").alias("id")))
        pairs = pairs.join(place.select(F.col("id").alias("i"), F.col("r").alias("ri")), "i").join(place.select(F.col("id").alias("j"), F.col("r").alias("rj")), "j")
        pairs = pairs.where("rj <> 2 * ri + 1").select("i", "j", "dist")
    return pairs


def cross_set_join(incoming: DataFrame, base: DataFrame, threshold: float = 0.1, strategy: str = "auto", compat_f32: bool = False) -> DataFrame:
    """i (of incoming), j (of base) and dist of all pairs within the threshold. Vectors of different lengths are an error."""
    sizes = profile(incoming), profile(base)
    if sizes[0][1] != sizes[1][1] and sizes[0][0] and sizes[1][0]:
        raise MixedDimensionsError(f"vectors of {sizes[0][1]} and of {sizes[1][1]} components")
    strategy = plan(max(sizes)) if strategy == "auto" else strategy
    if strategy == "blocked":
        return _blocked_sets(incoming, base, threshold, compat_f32, sizes)
    if strategy == "grid":
        return _grid(incoming, base, threshold, compat_f32, False, sizes)
    return _nested(incoming, base, threshold, compat_f32, False)


def duplicates(incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """Incoming rows with a match."""
    return incoming.join(matches.select(F.col("i").alias("idx")).distinct(), "idx", "left_semi")


def survivors(incoming: DataFrame, matches: DataFrame) -> DataFrame:
    return incoming.join(matches.select(F.col("i").alias("idx")).distinct(), "idx", "left_anti")


def _distances(x: np.ndarray, y: np.ndarray):
    """Of some rows of x at a time: where they begin, and their distances to all rows of y, summed component by component."""
    columns, step = np.ascontiguousarray(y.T), max(1, MATRIX_TILE // max(1, len(y)))
    for k in range(0, len(x), step):
        part = x[k : k + step]
        total, d = np.zeros((len(part), len(y))), np.empty((len(part), len(y)))
        with np.errstate(invalid="ignore", over="ignore"):
            for c, column in enumerate(columns):
                np.subtract(part[:, c, None], column, out=d)
                np.multiply(d, d, out=d)
                np.add(total, d, out=total)
        yield k, np.sqrt(total, out=total)


def _rounded(d: np.ndarray, decimals: int | None) -> np.ndarray:
    """Half up; from 2 ** 53 units of the last decimal on, doubles have no more decimals to round."""
    if decimals is None:
        return d
    with np.errstate(over="ignore"):
        units = d * 10.0**decimals
    return np.where(units < 2.0**53, np.floor(units + 0.5) / 10.0**decimals, d)


def _in_runs(ids: np.ndarray, others: np.ndarray, d: np.ndarray, mirrored: bool) -> list[np.ndarray]:
    """i, j and dist of a row of ids by a row of others; mirrored: each run of a row once more right away, with i and j exchanged.

    Distances have hardly a bit to spare, so a written matrix takes 8 bytes a row; where the other triangle follows within the window
    of a file's compression (64 KB with Snappy), both take them once.
    """
    runs, whole = [], len(others) // MATRIX_RUN * MATRIX_RUN
    for k, to, width in ((0, whole, MATRIX_RUN), (whole, len(others), len(others) - whole)):
        if k < to:
            across = d[:, k:to].reshape(len(ids), -1, 1, width).swapaxes(0, 1)
            own, met = (np.broadcast_to(x, across.shape) for x in (ids[:, None, None], others[k:to].reshape(-1, 1, 1, width)))
            sides = ((own, met), (met, own), (across, across)) if mirrored else ((own,), (met,), (across,))
            runs.append([np.concatenate(x, axis=2).ravel() for x in sides])
    return [np.concatenate(x) for x in zip(*runs, strict=True)]


def _blocked_matrix(a: DataFrame, b: DataFrame, decimals: int | None) -> DataFrame:
    """Blocks of up to MATRIX_ROWS rows, each block of a with each of b. A Cartesian product reads the written blocks again for
    each task, where a join would write a copy of every block for each block that it meets: disk grows with the rows alone.
    A matrix of a with itself is worked out once for both triangles, which come run by run: see _in_runs."""
    sizes = profile(a), profile(b)
    if sizes[0][1] != sizes[1][1] and sizes[0][0] and sizes[1][0]:
        raise MixedDimensionsError(f"vectors of {sizes[0][1]} and of {sizes[1][1]} components")
    same = a is b

    def side(df: DataFrame, size: tuple[int, int], name: str) -> DataFrame:
        n = max(_n_blocks(df, size), -(-size[0] // MATRIX_ROWS))
        return _dealt(df, n).repartition(min(n, MATRIX_PARTS)).select(F.struct("p", "ids", "m", "f32").alias(name))

    def run(batches):
        for row in (r for batch in batches for r in batch.to_pylist()):
            (ids, x), (others, y) = _unpacked(row["a"]), _unpacked(row["b"])
            mirrored = same and row["a"]["p"] != row["b"]["p"]
            for k, d in _distances(x, y):
                i, j, d = _in_runs(ids[k : k + len(d)], others, _rounded(d, decimals), mirrored)
                if (bad := np.isnan(d)).any():
                    i, j, d = i[~bad], j[~bad], d[~bad]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (i, j, d))], ["i", "j", "dist"])

    left, right = side(a, sizes[0], "a").hint("shuffle_replicate_nl"), side(b, sizes[1], "b")
    pairs = left.join(right, F.col("a.p") <= F.col("b.p")) if same else left.crossJoin(right)
    return pairs.mapInArrow(run, PAIRS)


def pairwise_matrix(a: DataFrame, b: DataFrame, strategy: str = "blocked", decimals: int | None = None) -> DataFrame:
    """i, j, dist of every pair, the diagonal and both triangles included; pairs without a distance (NaN, null) are left out.

    decimals rounds dist: where the blocks are, since Spark's round goes through decimal text for each row.
    """
    if strategy == "blocked":
        return _blocked_matrix(a, b, decimals)
    pairs = _nested(a, b, float("inf"), False, False)
    return pairs if decimals is None else pairs.withColumn("dist", F.round("dist", decimals))
