"""Near duplicates by b-bit MinHash.

One pass over the texts gives each document BANDS * ROWS minima over its word shingles. A band's key is a hash of its
full minima; of every minimum the BITS low bits are kept and packed, 80 bytes a document. Documents of equal word
sequences form classes first, and only a class's smallest id goes on. Ids that share a band key are candidates;
packed signatures give each candidate a similarity, corrected for low bits that agree by chance, and what lies
SLACK below the threshold (4.5 standard errors: a chance of 3e-6, as for the bands) is left. Links are confirmed on full shingle sets.

A bucket is not expanded into pairs. Each member is held against its buckets' smallest ids, best estimate first;
then, in buckets whose members are still in different components, members outside the largest component are held
against all of the other components, in tiles of two blocks of members, and only confirmed links leave a tile. So the components
are those of all confirmed candidates. Two texts of similarity 0.8 share no band with a chance of 3e-6.

Defined results: null, empty and white-space texts have no shingles, are linked with nothing and are kept. Rows of
one id are one node, and ties go to the smallest id. Very long texts are whole sets; a worker holds those of one batch of
some MB, or of one such text. A row without id is linked with nothing and kept, its component null. Extra columns are left
out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import textkit as T
from twinsift.llm.components import components
from twinsift.llm.shared import cut, drop_cut, parts, salted

NAME = "op4_minhash_near_dedup"

BANDS, ROWS, BITS = 32, 5, 4
SLACK = 0.15
#: Members of a block, when a bucket holds several components, pairs at a time, and MB of a task's packed texts.
BLOCK, PAIRS, TASK_MB = 2048, 200_000, 4
#: Texts that a task holds against one other.
HELD = 2048

_N = BANDS * ROWS
_A = (T.mix(np.arange(1, _N + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_B = (T.mix(np.arange(1001, _N + 1001, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_MIX = T.mix(np.arange(5001, 5001 + ROWS, dtype=np.uint64)) | np.uint64(1)


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of the texts and where each text's begin, then word hashes and where each text's begin. A text
    with fewer words has one shingle, of all of them."""
    buf = T.LOWER[buf]
    s, e, docs = T.bounds(buf, off)
    h = T.hashes(buf, s, e)
    n = np.diff(docs)
    v = np.zeros(len(h), np.uint64)
    g = T.grams(h, words)
    v[: len(g)] = g
    ok = np.ones(len(h), bool)
    for d in range(1, words):
        ok[docs[1:][n >= d] - d] = False
    for i in np.flatnonzero((n > 0) & (n < words)):
        v[docs[i]] = T.grams(h[docs[i] : docs[i + 1]], int(n[i]))[0] ^ np.uint64(n[i])
        ok[docs[i]] = True
    return v[ok], np.concatenate([[0], np.cumsum(np.where(n >= words, n - words + 1, (n > 0).astype(n.dtype)))]), h, docs


def _minima(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """_N minima for each text that has shingles; all of at's texts do."""
    x = (v ^ (v >> np.uint64(32))).astype(np.uint32)
    out = np.empty((_N, len(at) - 1), np.uint32)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 16), "right")) - 1)
        part = x[at[i] : at[j]]
        room, heads = np.empty_like(part), at[i:j] - at[i]
        for k in range(_N):
            np.multiply(part, _A[k], out=room)
            np.add(room, _B[k], out=room)
            out[k, i:j] = np.minimum.reduceat(room, heads)
        i = j
    return out


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a hash of the word sequence), bands (keys) and sig (packed low bits)."""
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>"
    names = ["doc_id", "n_shingles", "s1", "s2", "bands", "sig"]

    def run(frames):
        for whole in frames:
            for part in T.batches(whole, "text"):
                v, at, h, docs_at = shingles(*T.flat(part.column("text")), words)
                n = len(part.column("text"))
                some = np.flatnonzero(np.diff(at))
                size = np.zeros(n, np.int64)
                for i in some.tolist():
                    size[i] = len(np.unique(v[at[i] : at[i + 1]]))
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(docs_at[:-1], np.diff(docs_at)).astype(np.uint64)
                seq = np.zeros((2, n), np.int64)
                bands = sig = np.zeros((0, 0), np.int64)
                if len(some):
                    a = T.mix(h + place * np.uint64(0x9E3779B97F4A7C15))
                    b = T.mix(h ^ T.mix(place + np.uint64(77)))
                    for k, x in enumerate((a, b)):
                        seq[k, some] = np.add.reduceat(x, docs_at[some]).view(np.int64)
                    m = _minima(v, np.append(at[some], at[-1]))
                    wide = m.astype(np.uint64).reshape(BANDS, ROWS, -1)
                    keys = T.mix((wide * _MIX[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
                    bands = np.ascontiguousarray(keys.T).view(np.int64)
                    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS, len(some))
                    sig = np.ascontiguousarray((low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :, None]).sum(axis=1, dtype=np.uint64).T).view(np.int64)
                here = np.zeros(n, np.int64)
                here[some] = 1
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(here * w)]), pa.int32()), pa.array(x.reshape(-1))) for x, w in ((bands, BANDS), (sig, _N * BITS // 64))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in (size, seq[0], seq[1])), *lists], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _estimate(a, b):
    """Similarity from the low bits that agree: (share - chance) / (1 - chance)."""

    def differing(x, y):
        d = x.bitwiseXOR(y)
        for by in (1, 2)[: BITS // 2]:
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        mask = sum(1 << (BITS * k) for k in range(64 // BITS))
        return F.bit_count(d.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return (1 - off / F.lit(float(_N)) - chance) / (1 - chance)


def _estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    d = many ^ one
    for by in (1, 2)[: BITS // 2]:
        d = d | (d >> np.uint64(by))
    mask = np.uint64(sum(1 << (BITS * k) for k in range(64 // BITS)))
    chance = 2.0**-BITS
    return (1 - np.bitwise_count(d & mask).sum(axis=1) / _N - chance) / (1 - chance)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the text, compressed."""

    def run(frames):
        press = zstandard.ZstdCompressor(level=1)
        for f in frames:
            texts = f.column("text").fill_null("").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array([press.compress(x.as_buffer()) for x in texts], pa.binary())], ["id", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(run, "id long, z binary")


def _set(press, z: bytes, words: int) -> np.ndarray:
    """The sorted shingles of a packed text."""
    raw = np.frombuffer(press.decompress(z), np.uint8)
    return np.unique(shingles(raw, np.array([0, len(raw)]), words)[0])


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    n = int((y[at] == x).sum())
    return 100 * n >= percent * (len(x) + len(y) - n)


def _dealt(pairs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (id, m) and table (m once each) with a column salt to join on besides m: an m that many ids are held against is
    dealt over several tasks, HELD ids each; such m are few, and only their rows of the table are copied."""
    hubs = pairs.groupBy("m").agg(F.ceil(F.count("*") / HELD).cast("int").alias("salts")).where("salts > 1")
    held = table.join(hubs, "m", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    mine = salted(pairs, hubs, "m", "id").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    return mine, held


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (id, m) whose full shingle sets have 100 * intersection >= percent * union."""
    texts = texts.select("id", "z")
    left, held = _dealt(pairs.select("id", "m"), texts.select(F.col("id").alias("m"), F.col("z").alias("zm")))
    both = left.join(texts, "id").join(held, ["m", "salt"]).select("id", "m", "z", "zm")

    def run(frames):
        press, last = zstandard.ZstdDecompressor(), (None, None)
        for f in frames:
            keep = []
            for z, zm in zip(f.column("z"), f.column("zm"), strict=True):
                zm = zm.as_py()
                if last[0] != zm:
                    last = (zm, _set(press, zm, words))
                keep.append(_alike(_set(press, z.as_py(), words), last[1], percent))
            yield f.select(["id", "m"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "id long, m long").distinct()


def _between(least: float, words: int, percent: int):
    """Confirmed links between different components of a bucket.

    A table holds tiles, many of them: a block of the members outside a bucket's largest component (role 0) and a block of
    all its members (role 1). Pairs are made as positions, PAIRS at a time, and a candidate counts only in the first band that its
    members share, so once in all. Best estimate first, candidates whose components haven't met yet are compared on
    full sets; only links leave."""

    def run(table):
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        key, bx, by, role, ids, comp, big = (table.column(c).to_numpy() for c in ("key", "bx", "by", "role", "id", "component", "largest"))
        order = np.lexsort((role, by, bx, key))
        sig, bands, key, bx, by, role, ids, comp, big = (x[order] for x in (sig, bands, key, bx, by, role, ids, comp, big))
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])]))
        odd = np.flatnonzero(role == 0)
        tile = np.searchsorted(first, odd, "right") - 1
        n_odd = np.bincount(tile, minlength=len(first))
        start, size = first + n_odd, np.diff(np.append(first, len(ids))) - n_odd
        ends = np.cumsum(size[tile])
        found, at = [(odd[:0], odd[:0], np.zeros(0))], 0
        while at < len(odd):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = size[tile[at:to]]
            x = np.repeat(odd[at:to], n)
            y = np.repeat(start[tile[at:to]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            # a pair with both ends outside the largest component is made twice
            apart = (comp[x] != comp[y]) & ((comp[y] == big[y]) | (ids[x] < ids[y]))
            x, y = x[apart], y[apart]
            est = _estimates(sig[x], sig[y])
            near = est >= least
            x, y, est = x[near], y[near], est[near]
            band = (bands[x] == bands[y]).argmax(axis=1)
            here = bands[x, band] == key[x]
            found.append((x[here], y[here], est[here]))
            at = to
        x, y, est = (np.concatenate(z) for z in zip(*found, strict=True))
        press, texts, sets, root, out = zstandard.ZstdDecompressor(), table.column("z"), {}, {}, []

        def held(i: int) -> np.ndarray:
            k = int(ids[i])
            if k not in sets:
                sets[k] = _set(press, texts[int(order[i])].as_py(), words)
            return sets[k]

        def top(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        for k in np.argsort(-est, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            a, b = top(int(comp[i])), top(int(comp[j]))
            if a != b and _alike(held(i), held(j), percent):
                root[a] = b
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"id": pa.array([a for a, _ in out], pa.int64()), "m": pa.array([b for _, b in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs (doc_id, text)."""
    least = percent / 100 - SLACK
    sigs = cut(signatures(docs, words))
    some = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    # a class may hold a third of all rows, and AQE splits no join whose partitioning the next step needs
    member = salted(some.select("doc_id", "s1", "s2"), classes.where("rep < last"), ["s1", "s2"], "doc_id").where("doc_id > rep")
    member = cut(member.select("doc_id", "rep", "s1", "s2").distinct())
    reps = cut(some.join(member.select("doc_id", "s1", "s2"), ["doc_id", "s1", "s2"], "left_anti").select(F.col("doc_id").alias("id"), "bands", "sig"))
    sig = reps.select("id", "sig")
    # an id with several texts can be a class's copy and have a text of its own as well
    twice = member.select(F.col("doc_id").alias("id"), F.col("rep").alias("m")).join(sig.select("id"), "id", "left_semi")

    band = reps.select("id", F.explode("bands").alias("key"))
    star = band.groupBy("key").agg(F.min("id").alias("m"), F.max("id").alias("last"), F.count("*").alias("n")).where("m < last")
    shared = cut(band.join(star.select("key", "m", "n"), "key").select("id", "key", "m", "n"))
    pairs = shared.where("id > m").select("id", "m").distinct()
    left, held = _dealt(pairs, sig.select(F.col("id").alias("m"), F.col("sig").alias("sm")))
    scored = left.join(sig, "id").join(held, ["m", "salt"]).select("id", "m", _estimate(F.col("sig"), F.col("sm")).alias("est")).where(F.col("est") >= least)
    scored = cut(scored.groupBy("id", "m").agg(F.max("est").alias("est")))

    some_reps = reps.join(shared.select("id").distinct(), "id", "left_semi")
    texts = cut(_packed(docs).join(some_reps, "id"))
    first = scored.groupBy("id").agg(F.max_by("m", F.struct("est", -F.col("m"))).alias("m"))
    links = cut(_confirmed(first, texts, words, percent).unionAll(twice))
    label = components(links, "id", "m")

    def apart(p: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        a, b = label.select(F.col("node").alias("id"), F.col("component").alias("ca")), label.select(F.col("node").alias("m"), F.col("component").alias("cb"))
        return p.join(a, "id", "left").join(b, "m", "left").where(F.coalesce("ca", "id") != F.coalesce("cb", "m")).select("id", "m")

    def joined(label: DataFrame, new: DataFrame) -> DataFrame:
        """label with the components that new links (id, m) tie together made one."""
        a, b = label.select(F.col("node").alias("id"), F.col("component").alias("ca")), label.select(F.col("node").alias("m"), F.col("component").alias("cb"))
        ends = new.join(a, "id", "left").join(b, "m", "left").select(F.coalesce("ca", "id").alias("a"), F.coalesce("cb", "m").alias("b"))
        tied = components(ends).withColumnRenamed("component", "root")
        old = label.join(tied.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        more = tied.select("node", F.col("root").alias("component")).join(label.select("node"), "node", "left_anti")
        return cut(old.unionAll(more))

    rest = open_rest = cut(apart(scored.select("id", "m").join(first.select("id", "m"), ["id", "m"], "left_anti"), label))
    if not rest.isEmpty():
        label = joined(label, _confirmed(rest, texts, words, percent))

    # a bucket of two is one pair with its smallest id, and that has been tested
    wide = shared.where("n > 2").select("id", "key")
    named = wide.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max_by("component", "n").alias("largest"), F.sum("n").alias("total"), F.max("n").alias("most")).where("kinds > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = salted(named, open_, "key", "id").where("kinds > 1").withColumns({"nx": blocks(F.col("total") - F.col("most")), "ny": blocks(F.col("total"))})
    dealt = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    side = lambda role, x, y: rows.select("id", "key", "component", "largest", F.lit(role).alias("role"), x.alias("bx"), y.alias("by"))
    roles = side(0, dealt("nx"), every("ny")).where("component <> largest").unionAll(side(1, every("nx"), dealt("ny")))
    rows = rows_cut = cut(roles.withColumn("bx", F.explode("bx")).withColumn("by", F.explode("by")))
    # so many tasks that each holds some TASK_MB of packed texts
    held = rows.join(texts.select("id", (F.octet_length("z") + 8 * (BANDS + _N * BITS // 64)).alias("b")), "id").agg(F.sum("b")).first()[0] or 0
    tasks = parts(held, TASK_MB)
    rows = rows.join(texts, "id")
    part = F.pmod(F.xxhash64("key", "bx", "by"), F.lit(tasks)).alias("part")
    last = cut(rows.groupBy(part).applyInArrow(_between(least, words, percent), "id long, m long"))
    if not last.isEmpty():
        label = joined(label, last)
    label = cut(label)
    drop_cut(reps, shared, scored, texts, links, open_rest, rows_cut, last)

    end = sigs.select("doc_id", "n_shingles").join(member.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left")
    end = end.withColumn("node", F.coalesce("rep", "doc_id")).join(label, "node", "left")
    end = end.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return end.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS s FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(n - 3, 1)),
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM pairs JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.y, d.doc_id)) AS kept
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
