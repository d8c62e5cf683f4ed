"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat is a window of LENGTH words that starts in a document with a smaller id too. The tree is sparse: it holds the
suffixes that begin at anchors. The anchor of a window is its run of PREFIX words with the smallest hash, so equal windows
have their anchor at the same place, and every repeat is a path of the tree with some words to its left.

1. Prefixes. Each bucket of documents sends the distinct first PREFIX words of its anchored suffixes with their counts, as
   hashes, and hears which of them occur once in all (these suffixes lie in no repeat and stay at home) and which more
   than LIMIT times. Prefixes of the latter grow: 9 and 11 words are counted in the same way, and a window takes the
   shortest prefix that lies inside it and occurs at most LIMIT times; where there is none, all its LENGTH words.
2. Subtrees. Suffixes, cut off where no window of their anchor reaches further, go with their left words to the group of their
   prefix. Equal ones of one document bucket are sent once, with their smallest id. A group sorts its suffixes, takes the
   lengths of common prefixes (LCP) of neighbours, and so has the internal nodes of its subtree as runs of the sorted
   suffixes. Below a node of depth LENGTH - j or more, suffixes with the same j words to their left hold the same window;
   all but those of the smallest id are repeats. Windows of hot prefixes that grew to the whole window are leaves of full
   depth, sent as hashes of 24 bytes a document bucket. One bit a window goes back. Overlapping repeats of a document
   join into maximal ones.

So a group holds at most LIMIT suffixes of a prefix, and the count of groups follows the counted bytes. A document bucket
sends one row to each group that it has something for: in all no more rows than suffixes. Documents are dealt to buckets by
a hash, once, in compressed form; the passes over them share that exchange.

Defined results: null and empty texts have no words. Rows of one id aren't repeats of each other. A row without id comes
after all others. Of equal windows the smallest id's stays, in any order of rows. Very long texts are whole: words are
worked on in slices of some MB, and of one text at least. Extra columns are left out, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import textkit as T
from twinsift.llm.shared import parts, text_bytes

NAME = "op1_substring_dedup"

LENGTH, PREFIX = 13, 7
#: Words of the prefixes that PREFIX grows to, and how often one may occur.
LONGER, LIMIT = (9, 11), 20_000
LAST = np.iinfo(np.int64).max
#: MB of text for each bucket of documents, of prefixes and of suffixes.
DOC_MB, KEY_MB, TREE_MB = 12, 48, 12
#: Kinds of answers to a document bucket.
CODES, BITS, LONGER_CODES = 0, 1, 2


def _slices(table: pa.Table):
    """Ids, bytes and offsets of the texts, some MB at a time; in an order that doesn't depend on how rows arrive."""
    press = zstandard.ZstdDecompressor()
    ids = table.column("doc_id").fill_null(LAST).to_numpy()
    z = table.column("z").to_pylist()
    raw, at, size = [], [], 0
    for i in range(len(z)):
        raw.append(press.decompress(z[i]))
        at.append(i)
        size += len(raw[-1])
        if size >= 3 << 20 or i == len(z) - 1:
            off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            yield np.array(at), ids[at], b"".join(raw), off
            raw, at, size = [], [], 0


class _Windows:
    """The windows of a slice: their starts, the places of their anchors and the keys of the anchors' prefixes."""

    def __init__(self, raw: bytes, off: np.ndarray):
        buf = np.frombuffer(raw, np.uint8)
        self.s, self.e, self.docs = T.bounds(buf, off)
        self.h = T.hashes(buf, self.s, self.e)
        n = len(self.h) - LENGTH + 1
        ok = np.ones(max(n, 0), bool)
        for i in self.docs[1:]:
            ok[max(0, i - LENGTH + 1) : i] = False
        self.start = np.flatnonzero(ok)
        if not len(self.start):
            self.anchor, self.key = self.start, np.zeros(0, np.uint64)
            return
        g = T.grams(self.h, PREFIX)
        best, arg = g[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, LENGTH - PREFIX + 1):
            c = g[j : n + j]
            less = c < best
            best[less] = c[less]
            arg[less] = j
        self.anchor = self.start + arg[self.start]
        # minima are small numbers: mixed again, so that buckets of keys are even
        self.key = T.mix(best[self.start]) & ~np.uint64(0xFF)

    def anchors(self) -> np.ndarray:
        """The key of each anchored suffix's first PREFIX words, once for each place."""
        return self.key[_heads(self.anchor)] if len(self.start) else self.key

    def longer(self, pick: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows in pick, those that hold the first `words` words of their anchored suffix, and the keys of these."""
        pick = pick[self.anchor[pick] + words <= self.start[pick] + LENGTH]
        if not len(pick):
            return pick, np.zeros(0, np.uint64)
        g = T.mix(T.grams(self.h, words)[self.anchor[pick]] + np.uint64(words))
        return pick, g & ~np.uint64(0xFF)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each key, rising with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _rows(names, columns):
    return pa.table(dict(zip(names, columns, strict=True)))


def _counted(d: int, keys: list[np.ndarray], n_keys: int):
    """A row for each bucket of keys: its sorted distinct keys, with their counts (255 at most) in the low bytes."""
    keys, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    packed = keys | np.minimum(counts, 255).astype(np.uint64)
    group = _bucket(keys, n_keys)
    at = np.append(_heads(group), len(keys))
    blobs = [packed[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return _rows(["k", "d", "blob"], [pa.array(group[at[:-1]]), pa.array([d] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())])


def _send_keys(n_keys: int):
    def run(key, table):
        return _counted(key[0].as_py(), [_Windows(raw, off).anchors() for _, _, raw, off in _slices(table)], n_keys)

    return run


def _judge_keys(limit: int, kind: int):
    """For each key of each document bucket: 0 occurs once, 1 is shared, 2 occurs more than limit times."""

    def run(table):
        blobs = [np.frombuffer(b, np.uint64) for b in table.column("blob").to_pylist()]
        packed = np.concatenate(blobs)
        _, inverse = np.unique(packed & ~np.uint64(0xFF), return_inverse=True)
        total = np.bincount(inverse, weights=(packed & np.uint64(0xFF)).astype(np.float64))
        code = ((total > 1).astype(np.uint8) + (total > limit))[inverse].astype(np.uint8)
        press = zstandard.ZstdCompressor(level=1)
        ends = np.cumsum([len(b) for b in blobs])
        out = [press.compress(code[e - len(b) : e].tobytes()) for b, e in zip(blobs, ends, strict=True)]
        return _rows(["d", "kind", "k", "blob"], [table.column("d"), pa.array([kind] * len(blobs), pa.int32()), table.column("k"), pa.array(out, pa.binary())])

    return run


def _answer(answers: pa.Table, kind: int) -> np.ndarray:
    """The answers of a kind to a document bucket, in order of the buckets that gave them."""
    press = zstandard.ZstdDecompressor()
    rows = sorted((k, b) for x, k, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "k", "blob")), strict=True) if x == kind)
    return np.concatenate([np.frombuffer(press.decompress(b), np.uint8) for _, b in rows]) if rows else np.zeros(0, np.uint8)


def _judged(docs: pa.Table, answers: pa.Table):
    """Slices of a bucket's texts with their windows and the code of each window's prefix."""
    code = _answer(answers, CODES)
    held = [(*part, _Windows(part[2], part[3])) for part in _slices(docs)]
    keys = np.unique(np.concatenate([w.anchors() for *_, w in held]))
    return [(*part, code[np.searchsorted(keys, part[-1].key)] if len(part[-1].key) else np.zeros(0, np.uint8)) for part in held]


def _send_longer(n_keys: int):
    """Counts of the longer prefixes of those that occur too often."""

    def run(key, docs, answers):
        keys = []
        if docs.num_rows and (_answer(answers, CODES) == 2).any():
            for *_, w, code in _judged(docs, answers):
                for words in LONGER:
                    pick, longer = w.longer(np.flatnonzero(code == 2), words)
                    keys.append(longer[_heads(w.anchor[pick])])
        return _counted(key[0].as_py(), keys, n_keys)

    return run


class _Suffixes:
    """The stretches of a bucket's texts whose windows share an anchor and a prefix that occur elsewhere, and the distinct
    ones among them. Worked out again in each pass, in the same order."""

    def __init__(self, docs: pa.Table, answers: pa.Table, n_trees: int):
        held = _judged(docs, answers)
        more, fits = [], None
        if any((code == 2).any() for *_, code in held):
            for *_, w, code in held:
                more.append([w.longer(np.flatnonzero(code == 2), words) for words in LONGER])
            known = np.unique(np.concatenate([k for one in more for _, k in one]))
            fits = (known, _answer(answers, LONGER_CODES) < 2)
        self.parts, cols = [], []
        for p, (at, ids, raw, off, w, code) in enumerate(held):
            route, words = w.key.copy(), np.where(code == 2, LENGTH, PREFIX)
            for length, (some, keys) in zip(LONGER[::-1], more[p][::-1] if more else (), strict=bool(more)):
                if len(some):
                    ok = fits[1][np.searchsorted(fits[0], keys)]
                    route[some[ok]], words[some[ok]] = keys[ok], length
            pick = np.flatnonzero(code)
            start, anchor, words = w.start[pick], w.anchor[pick], words[pick]
            head = np.ones(len(pick), bool)
            head[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (words[1:] != words[:-1]) | (words[1:] == LENGTH)
            head = np.flatnonzero(head)
            lo, n = start[head], np.diff(np.append(head, len(pick)))
            hi = lo + n + LENGTH - 1
            up, down = T._pow("up", len(w.h) + 1), T._pow("down", len(w.h) + 1)
            two = []
            for h in (w.h, T.mix(w.h ^ np.uint64(0xABCDEF))):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
                two.append(T.mix((sums[hi] - sums[lo]) * down[lo] + n.astype(np.uint64)))
            full = words[head] == LENGTH
            to = np.where(full, two[0], route[pick][head])
            owner = np.searchsorted(w.docs, lo, "right") - 1
            self.parts.append((at, ids, raw, off, w, lo, n, owner))
            spans = (w.s[lo], w.e[hi - 1]) if len(lo) else (lo, lo)
            cols.append((_bucket(to, n_trees), full, *two, ids[owner], *spans, np.full(len(lo), p), n, anchor[head] - lo))
        group, full, h1, h2, doc, a, b, part, n, place = (np.concatenate(x) for x in zip(*cols, strict=True))
        order = np.lexsort((h2, h1, full, group))
        new = np.ones(len(order), bool)
        new[1:] = False
        for x in (group, full, h1, h2):
            new[1:] |= x[order][1:] != x[order][:-1]
        heads = np.flatnonzero(new)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        first = order[heads]
        self.least = np.minimum.reduceat(doc[order], heads) if len(heads) else doc
        self.group, self.full, self.n, self.place, self.hash = group[first], full[first], n[first], place[first], (h1[first], h2[first])
        self.span = (a[first], b[first], part[first])

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.parts[p][2][a:b] for a, b, p in zip(*(x[i:j].tolist() for x in self.span), strict=True)]


def _send_suffixes(n_trees: int):
    """A row for each group: the texts of the suffixes with their sizes, smallest ids and anchors' places, and the windows
    of full depth as two hashes and a smallest id."""

    def run(key, docs, answers):
        out = []
        if docs.num_rows and answers.num_rows:
            press = zstandard.ZstdCompressor(level=1)
            f = _Suffixes(docs, answers, n_trees)
            at = np.append(_heads(f.group), len(f.group)).tolist()
            for i, j in zip(at[:-1], at[1:], strict=True):
                m = i + int((~f.full[i:j]).sum())
                texts = f.text(i, m)
                meta = np.concatenate([np.array([len(t) for t in texts], np.int64), f.least[i:m], f.place[i:m]])
                leaves = np.concatenate([f.hash[0][m:j].view(np.int64), f.hash[1][m:j].view(np.int64), f.least[m:j]])
                out.append((int(f.group[i]), key[0].as_py(), press.compress(b"".join(texts)), press.compress(meta.tobytes()), leaves.tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return _rows(["g", "d", "z", "meta", "leaves"], [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)])

    return run


def subtree(raw: bytes, off: np.ndarray, least: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each window of the stretches, in order: a deep node above its suffix holds the same window with an id
    smaller than the stretch's own. And the number of windows of each stretch. place: words before the anchored suffix."""
    buf = np.frombuffer(raw, np.uint8)
    s, e, docs = T.bounds(buf, off)
    h = T.hashes(buf, s, e)
    n = np.diff(docs) - LENGTH + 1
    bits = np.zeros(int(n.sum()), bool)
    if not len(n):
        return bits, n
    begin = docs[:-1] + place
    # the words of each suffix, 0 beyond its end; suffixes in order of their words' hashes
    col = np.arange(LENGTH)
    words = np.where(col < (docs[1:] - begin)[:, None], h[np.minimum(begin[:, None] + col, len(h) - 1)], np.uint64(0))
    top = words[:, 0].copy()
    for k in range(1, PREFIX):
        top = T.mix(top * np.uint64(T._BASE) + words[:, k])
    order = np.lexsort((*(words[:, k] for k in range(LENGTH - 1, PREFIX - 1, -1)), top))
    words = words[order]
    same = (words[1:] == words[:-1]) & (words[1:] != 0)
    lcp = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    left, base = np.zeros(len(n), np.uint64), np.cumsum(n) - n
    for j in range(LENGTH - PREFIX + 1):
        if j:
            left = T.mix(left * np.uint64(T._BASE) + h[np.maximum(begin - j, 0)])
        k = place - j
        some = np.flatnonzero((k >= 0) & (k < n))
        if not len(some):
            continue
        # the node of depth LENGTH - j or more above each suffix: runs between shorter common prefixes
        node = np.zeros(len(n), np.uint64)
        node[order[1:]] = np.cumsum(lcp < LENGTH - j).astype(np.uint64)
        _, window = np.unique(T.mix(node[some] * np.uint64(T._INVERSE) ^ left[some]), return_inverse=True)
        smallest = np.full(int(window.max()) + 1, LAST)
        np.minimum.at(smallest, window, least[some])
        bits[(base + k)[some]] = smallest[window] < least[some]
    return bits, n


def _grow_trees(table):
    press, back = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    raws = [press.decompress(z) for z in table.column("z").to_pylist()]
    metas = [np.frombuffer(press.decompress(m), np.int64).reshape(3, -1) for m in table.column("meta").to_pylist()]
    size, least, place = np.concatenate(metas, axis=1)
    bits, n = subtree(b"".join(raws), np.concatenate([[0], np.cumsum(size)]), least, place)
    leaves = [np.frombuffer(x, np.int64).reshape(3, -1) for x in table.column("leaves").to_pylist()]
    h1, h2, ids = np.concatenate(leaves, axis=1)
    order = np.lexsort((h2, h1))
    full = np.zeros(len(ids), bool)
    if len(ids):
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        full[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1] < ids[order]
    windows = np.concatenate([[0], np.cumsum(n)])
    out, i, j = [], 0, 0
    for m, x in zip(metas, leaves, strict=True):
        mine = np.concatenate([bits[windows[i] : windows[i + m.shape[1]]], full[j : j + x.shape[1]]])
        i, j = i + m.shape[1], j + x.shape[1]
        out.append(back.compress(mine.astype(np.uint8).tobytes()))
    return _rows(["d", "kind", "k", "blob"], [table.column("d"), pa.array([BITS] * len(out), pa.int32()), table.column("g"), pa.array(out, pa.binary())])


def _remove(n_trees: int, text: bool):
    def run(key, docs, answers):
        ids, words, gone, sha, kept, spans = [], [], [], [], [], []
        if docs.num_rows:
            f = _Suffixes(docs, answers, n_trees)
            bits = _answer(answers, BITS)
            base = np.cumsum(f.n) - f.n
            seen = 0
            doc_ids = docs.column("doc_id").to_pylist()
            for at, own, raw, off, w, lo, n, owner in f.parts:
                entry = f.entry[seen : seen + len(lo)]
                seen += len(lo)
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                hit = (bits[np.repeat(base[entry], n) + within] > 0) | np.repeat(own[owner] > f.least[entry], n)
                start = (np.repeat(lo, n) + within)[hit]
                edge = np.zeros(len(w.h) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + LENGTH, -1)
                covered = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(covered)])
                for i, row in enumerate(at.tolist()):
                    a, b = int(w.docs[i]), int(w.docs[i + 1])
                    out = raw[off[i] : off[i + 1]].split()
                    some = int(total[b] - total[a])
                    if some:
                        out = compress(out, (~covered[a:b]).tolist())
                    joined = b" ".join(out)
                    ids.append(doc_ids[row])
                    words.append(b - a)
                    gone.append(some)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    if text:
                        step = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
                        spans.append([{"from": int(x), "to": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)])
                        kept.append(joined.decode("utf-8", "replace"))
        cols = [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if text:
            cols += [pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
            names += ["kept_text", "repeats"]
        return _rows(names, cols)

    return run


def _squeezed(docs: DataFrame, n: int) -> DataFrame:
    def run(frames):
        press = zstandard.ZstdCompressor(level=1)
        for f in frames:
            texts = f.column("text").fill_null("").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([f.column("d"), f.column("doc_id"), pa.array([press.compress(x.as_buffer()) for x in texts], pa.binary())], ["d", "doc_id", "z"])

    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dealt.mapInArrow(run, "d long, doc_id long, z binary")


def remove_repeats(docs: DataFrame, text: bool = False, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256; with text also kept_text and repeats, the maximal repeats as word ranges."""
    n_bytes = text_bytes(docs)
    n_docs, n_keys, n_trees = (parts(n_bytes, mb) for mb in (DOC_MB, KEY_MB, TREE_MB))
    held = _squeezed(docs, n_docs)
    by_doc = held.groupBy("d")
    key, reply = "k long, d long, blob binary", "d long, kind int, k long, blob binary"
    codes = by_doc.applyInArrow(_send_keys(n_keys), key).groupBy("k").applyInArrow(_judge_keys(limit, CODES), reply)
    longer = by_doc.cogroup(codes.groupBy("d")).applyInArrow(_send_longer(n_keys), key).groupBy("k").applyInArrow(_judge_keys(limit, LONGER_CODES), reply)
    codes = codes.unionAll(longer)
    suffixes = by_doc.cogroup(codes.groupBy("d")).applyInArrow(_send_suffixes(n_trees), "g long, d long, z binary, meta binary, leaves binary")
    bits = suffixes.groupBy("g").applyInArrow(_grow_trees, reply)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, repeats array<struct<`from`:long,`to`:long>>" * text
    return by_doc.cogroup(codes.unionAll(bits).groupBy("d")).applyInArrow(_remove(n_trees, text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
win AS (SELECT doc_id, i, n, x, concat_ws(' ', x, """ + ", ".join(f"lead(x, {k}) OVER o" for k in range(1, LENGTH)) + rf""") AS s FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, x, coalesce(i <= n - {LENGTH - 1} AND min(CASE WHEN i <= n - {LENGTH - 1} THEN doc_id END) OVER (PARTITION BY s) < doc_id, FALSE) AS hit FROM win),
c AS (SELECT doc_id, i, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
