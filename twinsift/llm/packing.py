"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Pieces are dealt at random into groups of about GROUP pieces. ISLANDS islands work on each group, each with its own
population of packings. Crossover injects whole well-filled bins of one parent into the other, drops the bins that
then hold a document twice, swaps documents displaced by that into bins that they fill better, and best-fits the rest;
mutation does so with the emptiest bins. After each epoch every island hands its best packing to the next one of its group.
An island stops as soon as it meets the lower bound on bins, or after STALL generations without a bin less; groups in which
best-fit decreasing meets that bound, and so can't be beaten, need no islands. Bins that stay loosely filled are opened again and their pieces pooled over the
groups, level after level, so that groups cost next to nothing in bins.

Token ids never leave the Python worker unless asked for: a piece is its length and checksum. Where the tokenizer's file says
that it cuts at white space in the known way, words are looked up by hash in a table that each worker fills through the
tokenizer's own model, in bounded size; any other tokenizer is given whole texts.

Defined results: null and empty texts are documents of id 0 alone. Repeated rows are packed as often as they occur.
Very long texts are cut into whole sequences and a rest. Extra columns are left out, whatever their names.
Pieces of equal length are interchangeable: which goes where is settled by a hash of their row numbers. An empty table gives
an empty result.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import textkit as T
from twinsift.llm.shared import cut, drop_cut

NAME = "op8_best_fit_packing"
SQL = None

CAPACITY = 2048
GROUP = 4096
ISLANDS = 2
EPOCHS = 2
#: Generations in a row without a bin less that end an island's epoch.
STALL = 8
POPULATION = 6
#: Bins that a child tries to fill better by swaps.
TRIES = 64
#: Tasks that islands are dealt over, at most.
TASKS = 8192
#: Bins filled less than this are opened again at the next level.
LOOSE = 0.98
#: Words that a worker remembers, and ids of theirs: where white space is rare, a word is a whole text.
MEMORY = 1_500_000
ROOM = 8_000_000
#: Words learnt last, kept apart, so that the large table is seldom written anew.
LATE = 100_000
#: Bytes of texts that a worker takes at once.
PART = 1 << 19

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How a tokenizer must prepare texts for _Words to hold, as its file says it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _wordwise(tokenizer) -> bool:
    """Whether the tokenizer cuts at white space in the way that _Words takes for granted."""
    told = json.loads(tokenizer.to_str())
    steps = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    byte = [x for x in steps[1:] if x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"]]
    same = steps[0].get("pattern") == _SPLIT and steps[0].get("invert") is True and len(byte) == len(steps) - 1 == 1
    return same and told["normalizer"] == _NORMALIZER and told["model"]["type"] == "BPE" and not told["model"]["dropout"]


class _Texts:
    """Ids of whole texts, as the tokenizer itself gives them; for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        lists = [np.array([*e.ids, 0], np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


class _Words:
    """Ids of words by hash. A text's ids are those of its words in a row: the tokenizer cuts at white space."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.model = self.tokenizer.model
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.letters = {b: chr(b) for b in range(256)} | {b: chr(256 + i) for i, b in enumerate(odd)}
        self.clear()

    def clear(self) -> None:
        self.words = self.late = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        self.ids = np.zeros(1 << 16, np.uint32)  # at 0 the end of a document
        self.used = 1

    def encode(self, word: bytes) -> list[int]:
        s = word.decode("utf-8", "replace")
        if "<|" in s or not _PLAIN.fullmatch(s):
            return self.tokenizer.encode(s, add_special_tokens=False).ids
        out = []
        for p in _PIECES.findall(s.lower()):
            p = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            out += [t.id for t in self.model.tokenize(p)]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words' ids begin, how many they are, and which words aren't known."""
        start, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        new = np.ones(len(keys), bool)
        for known, s, c in (self.words, self.late):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                start[hit], count[hit] = s[at[hit]], c[at[hit]]
                new &= ~hit
        return start, count, np.flatnonzero(new)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Adds words; keys are sorted."""
        lists = [self.encode(w) for w in words]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = self.used + np.cumsum(count)
        if ends[-1] > len(self.ids):
            more = np.empty(max(int(ends[-1]), 2 * len(self.ids)), np.uint32)
            more[: self.used] = self.ids[: self.used]
            self.ids = more
        self.ids[self.used : ends[-1]] = np.fromiter((x for one in lists for x in one), np.uint32, int(count.sum()))
        self.used = int(ends[-1])
        merge = lambda into, rows: tuple(np.insert(x, np.searchsorted(into[0], rows[0]), y) for x, y in zip(into, rows, strict=True))
        self.late = merge(self.late, (keys, ends - count, count))
        if len(self.late[0]) > LATE:
            self.words, self.late = merge(self.words, self.late), tuple(x[:0] for x in self.late)
        return ends - count, count

    def of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with id 0 at its end, and where each text's begin."""
        s, e, docs = T.bounds(buf, off)
        h, first, inverse = np.unique(T.hashes(buf, s, e), return_index=True, return_inverse=True)
        if len(self.words[0]) + len(self.late[0]) + len(h) > MEMORY or self.used > ROOM:
            self.clear()
        start, count, new = self.find(h)
        if len(new):
            raw = buf.tobytes()
            start[new], count[new] = self.learn(h[new], [raw[s[i] : e[i]] for i in first[new]])
        start = np.insert(start[inverse], docs[1:], 0)
        count = np.insert(count[inverse], docs[1:], 1)
        ends = np.cumsum(count)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(start - ends + count, count)]
        return ids, np.concatenate([[0], ends[docs[1:] + np.arange(len(off) - 1)]])


def _reader(path: str) -> _Words | _Texts:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return _Words(tokenizer) if _wordwise(tokenizer) else _Texts(tokenizer)


_words: dict[str, _Words | _Texts] = {}


def tokenized(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, where asked for, ids: the pieces of every document."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def run(batches):
        if path not in _words:
            _words[path] = _reader(path)
        words = _words[path]
        for whole in batches:
            for part in T.batches(whole, "text", PART):
                tokens, at = words.of(*T.flat(part.column("text")))
                size = np.diff(at)
                n = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[owner] - start)
                raw = memoryview(tokens.astype("<u4").tobytes())
                begin = at[owner] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [part.column("doc_id").take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


class _Bins:
    """A packing that is being built: open bins by the room that they have."""

    def __init__(self, capacity: int):
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.bins, self.capacity = 0, [], capacity

    def put(self, room: int, b: int) -> None:
        self.room[room].append(b)
        self.mask |= 1 << room

    def keep(self, items: list[int], load: int) -> None:
        self.bins.append(items)
        self.put(self.capacity - load, len(self.bins) - 1)

    def best_fit(self, items, lens) -> None:
        for i in items:
            n = lens[i]
            fits = self.mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = self.room[room].pop()
                if not self.room[room]:
                    self.mask ^= 1 << room
                self.bins[b].append(i)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
            self.put(room - n, b)


def _fitness(bins, lens, capacity) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return len(bins), -sum((sum(lens[i] for i in b) / capacity) ** 2 for b in bins)


def _swap(bins: list[list[int]], displaced: list[int], lens, capacity, rng) -> None:
    """Displaced pieces take the place of one or two smaller ones, or two of two, wherever that fills a bin better; what
    they replace is displaced instead. Some bins are tried, the last pieces of each against those displaced."""
    free = sorted((lens[i], i) for i in displaced)
    for b in rng.sample(range(len(bins)), min(len(bins), TRIES)):
        items = bins[b]
        load = sum(lens[i] for i in items)
        while load < capacity and free:
            last = sorted(items, key=lambda i: lens[i])[:6]
            out = [(lens[i], (i,)) for i in last] + [(lens[i] + lens[j], (i, j)) for x, i in enumerate(last) for j in last[:x]]
            best = (0, (), ())
            for n, gone in out:
                most = capacity - load + n
                at = bisect_right(free, (most, 1 << 62)) - 1
                if at >= 0 and free[at][0] - n > best[0]:
                    best = (free[at][0] - n, gone, (free[at],))
                for x in range(max(0, at - 6), at + 1) if len(gone) == 2 else ():
                    y = bisect_right(free, (most - free[x][0], 1 << 62), 0, x) - 1
                    if y >= 0 and free[x][0] + free[y][0] - n > best[0]:
                        best = (free[x][0] + free[y][0] - n, gone, (free[x], free[y]))
            if not best[0]:
                break
            load += best[0]
            for one in best[2]:
                free.remove(one)
                items.append(one[1])
            for i in best[1]:
                items.remove(i)
                insort(free, (lens[i], i))
    displaced[:] = [i for _, i in reversed(free)]


def _repacked(kept: list[list[int]], displaced: list[int], lens, capacity, rng) -> list[list[int]]:
    """kept with the displaced pieces swapped in where they fill better, and the rest best-fitted."""
    _swap(kept, displaced, lens, capacity, rng)
    out = _Bins(capacity)
    for items in kept:
        out.keep(items, sum(lens[i] for i in items))
    out.best_fit(displaced, lens)
    return out.bins


def _cross(into, donor, lens, capacity, rng):
    loads = [sum(lens[i] for i in b) for b in donor]
    best = sorted(range(len(donor)), key=lambda b: -loads[b])[: max(1, len(donor) // 2)]
    injected = rng.sample(best, max(1, len(best) // 2))
    taken = {i for b in injected for i in donor[b]}
    kept = [list(donor[b]) for b in injected]
    displaced = []
    for b in into:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += (i for i in b if i not in taken)
    return _repacked(kept, displaced, lens, capacity, rng)


def _mutate(bins, lens, capacity, rng):
    order = sorted(range(len(bins)), key=lambda b: sum(lens[i] for i in bins[b]))
    open_ = {*order[: max(2, len(bins) // 20)], *rng.sample(order, min(len(order), 2))}
    kept = [list(items) for b, items in enumerate(bins) if b not in open_]
    return _repacked(kept, [i for b in open_ for i in bins[b]], lens, capacity, rng)


def best_fit_decreasing(lens: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    out = _Bins(capacity)
    out.best_fit(sorted(range(len(lens)), key=lambda i: -lens[i]), lens)
    return out.bins


def lower_bound(lens, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: for the sum, and one for each piece over half a bin."""
    return max(-(-int(sum(lens)) // capacity), sum(2 * int(n) > capacity for n in lens))


def evolve(lens: list[int], seed: int, guests=(), capacity: int = CAPACITY, stall: int = STALL, population: int = POPULATION) -> list[list[int]]:
    """One island's epoch: the best packing that it finds, as lists of positions in lens. It ends at the lower bound on bins, or
    after `stall` generations in a row without a bin less."""
    if not lens:
        return []
    rng = random.Random(seed)
    bound = lower_bound(lens, capacity)
    pool = [g for g in guests if g]
    if not pool:
        pool.append(best_fit_decreasing(lens, capacity))
    if min(map(len, pool)) <= bound:
        return min(pool, key=len)
    order = sorted(range(len(lens)), key=lambda i: -lens[i])
    while len(pool) < population:
        other = _Bins(capacity)
        other.best_fit(sorted(order, key=lambda i: -(lens[i] + rng.random() * capacity / 8)), lens)
        pool.append(other.bins)
    rank = lambda b: _fitness(b, lens, capacity)
    pool = sorted(((rank(b), k, b) for k, b in enumerate(pool)))
    made, idle = len(pool), 0
    while pool[0][0][0] > bound and idle < stall:
        before = pool[0][0][0]
        for _ in range(population // 2):
            a, b = rng.sample(pool, 2)
            child = _cross(a[2], b[2], lens, capacity, rng)
            if rng.random() < 0.5:
                child = _mutate(child, lens, capacity, rng)
            made += 1
            pool.append((rank(child), made, child))
        pool = sorted(pool)[:population]
        idle = idle + 1 if pool[0][0][0] == before else 0
    return pool[0][2]


def _as_list(numbers) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        bins.setdefault(int(b), []).append(i)
    return list(bins.values())


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _first(capacity: int):
    def run(frames):
        for f in frames:
            out = []
            for g, rids, lens in zip(f.g, f.rids, f.lens, strict=True):
                bins = best_fit_decreasing([int(x) for x in lens], capacity)
                out.append((g, rids, lens, _numbers(bins, len(lens)), len(bins), lower_bound(lens, capacity)))
            yield pd.DataFrame(out, columns=["g", "rids", "lens", "mine", "n", "bound"])

    return run


def _epoch(capacity: int):
    def run(frames):
        for f in frames:
            out = []
            for g, r, lens, mine, guest in zip(f.g, f.r, f.lens, f.mine, f.guest, strict=True):
                bins = evolve([int(x) for x in lens], int(g) * ISLANDS + int(r), [_as_list(x) for x in (mine, guest) if x is not None], capacity)
                out.append((g, r, lens, _numbers(bins, len(lens)), len(bins)))
            yield pd.DataFrame(out, columns=["g", "r", "lens", "mine", "n"])

    return run


def _places(capacity: int):
    """Offsets of the pieces in their bins, and the bins' loads."""

    def run(frames):
        for f in frames:
            out = []
            for g, rids, lens, mine in zip(f.g, f.rids, f.lens, f.mine, strict=True):
                order = np.argsort(mine, kind="stable")
                n, b = np.asarray(lens, np.int64)[order], np.asarray(mine)[order]
                ends = np.cumsum(n)
                head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                size = np.diff(np.concatenate([head, [len(b)]]))
                base = np.repeat(ends[head] - n[head], size)
                load = np.repeat(np.add.reduceat(n, head), size)
                out.append(pd.DataFrame({"g": g, "rid": np.asarray(rids)[order], "length": n, "bin": b.astype(np.int64), "offset": ends - n - base, "load": load}))
            if out:
                yield pd.concat(out)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """tokenized() with sequence_id and offset: the place of each piece."""
    pieces = cut(tokenized(docs, tokenizer, capacity, ids).withColumn("rid", F.monotonically_increasing_id()))
    left = pieces.where(F.col("length") < capacity).select("rid", "length")
    done, level, n = None, 0, left.count()
    while n:
        groups = -(-n // GROUP)
        items = left.groupBy(F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(groups)).alias("g")).agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), "rid"))).alias("x"))
        items = items.select("g", F.transform("x", lambda x: x["rid"]).alias("rids"), F.transform("x", lambda x: (-x["l"]).cast("int")).alias("lens"))
        # best-fit decreasing first: groups whose packing meets the lower bound on bins are done
        start = cut(items.repartition(min(groups, TASKS), "g").mapInPandas(_first(capacity), "g long, rids array<long>, lens array<int>, mine array<int>, n long, bound long"))
        islands = start.where("n > bound").select("g", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("r"), "lens", "mine", F.lit(None).cast("array<int>").alias("guest"), "n")
        best, done_with = start.select("g", "rids", "lens", "mine"), [start]
        tasks = min(islands.count(), TASKS)
        if tasks:
            for epoch in range(EPOCHS):
                if epoch:
                    guests = islands.select("g", F.pmod(F.col("r") + 1, F.lit(ISLANDS)).alias("r"), F.col("mine").alias("guest"))
                    islands = islands.drop("guest").join(guests, ["g", "r"])
                # a task for each island, however small they are, up to TASKS
                dealt = islands.select("g", "r", "lens", "mine", "guest").repartition(tasks, "g", "r")
                islands = cut(dealt.mapInPandas(_epoch(capacity), "g long, r int, lens array<int>, mine array<int>, n long"))
                done_with.append(islands)
            found = start.select("g", "n", F.lit(-1).alias("r"), "mine").unionAll(islands.select("g", "n", "r", "mine"))
            best = best.drop("mine").join(found.groupBy("g").agg(F.min_by("mine", F.struct("n", "r")).alias("mine")), "g")
        placed = cut(best.mapInPandas(_places(capacity), "g long, rid long, length long, bin long, offset long, load long"))
        drop_cut(*done_with)
        loose = placed.where(F.col("load") < LOOSE * capacity)
        more = loose.count() if groups > 1 else 0
        last = groups == 1 or more == 0 or more > 0.7 * n
        settled = (placed if last else placed.where(F.col("load") >= LOOSE * capacity)).select("rid", "offset", ((F.lit(level) * (1 << 40) + F.col("g")) * (1 << 16) + F.col("bin")).alias("sequence_id"))
        done = settled if done is None else done.unionAll(settled)
        if last:
            break
        left, level, n = loose.select("rid", "length"), level + 1, more
    whole = pieces.where(F.col("length") >= capacity).select("*", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if done is None:
        return whole.drop("rid")
    part = pieces.where(F.col("length") < capacity).join(done, "rid").select(*whole.columns)
    return whole.unionAll(part).drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
