"""Packing: ids against the tokenizer, places against the rules, and the bin count against the lower bound."""

import zlib

import numpy as np
import pandas as pd
import pytest

tokenizers = pytest.importorskip("tokenizers")
from twinsift.llm import packing  # noqa: E402

SCHEMA = "doc_id long, text string, piece string"
ODD = [
    "", None, "   \n\t ", "word", "It's 3rd-party; they'll don't 'S", "naïve Straße ÀÉÎ œuvre ﬁne", "日本語 text 한국어",
    "a b c d", "é ́x", "x<|endoftext|>y <|startoftext|>", "İstanbul ΑΣ ΑΣ.", "1234 5.6 £€¥ ½ ª º µ × ÷", "\x1c\x1d\x85 q", "🙂🙂 ok…",
]


def brute(texts, capacity=packing.CAPACITY):
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    out = []
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def check(rows, capacity=packing.CAPACITY):
    """Places are gapless and within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return by


def test_ids_and_places(spark):
    texts = ODD + ["the quick brown fox " * 3000]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], SCHEMA)
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute(texts)
    check(rows)


def test_ids_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    got = packing.tokenized(docs, ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    want = {d: t.encode(x, add_special_tokens=False).ids + [0] for d, x in texts.items()}
    for r in got:
        assert r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    rows = packing.pack(docs).collect()
    assert len(rows) == len(got)
    by = check(rows)
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // packing.CAPACITY) * 1.05 + 1


def test_memory_of_long_words_is_bounded(monkeypatch):
    """Texts without white space are words of their own: the ids that a worker remembers are bounded, not only the words."""
    monkeypatch.setattr(packing, "ROOM", 20_000, raising=False)
    words = packing._reader(packing.default_tokenizer())
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    for i in range(60):
        texts = [f"日本語{i}" * 500 + f" word{i} the", f"x{i}-" * 300]
        raw = [x.encode() for x in texts]
        ids, at = words.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        assert words.ids.nbytes <= 4 * 100_000


def test_words_are_found_again_in_either_table(monkeypatch):
    """Learnt last, merged into the large table, or forgotten in between: the ids stay those of the tokenizer."""
    monkeypatch.setattr(packing, "LATE", 7)
    monkeypatch.setattr(packing, "MEMORY", 60)
    words = packing._reader(packing.default_tokenizer())
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    for i in range(40):
        raw = " ".join(f"w{j * j % 97}" for j in range(i, i + 12)).encode()
        ids, _ = words.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == t.encode(raw.decode(), add_special_tokens=False).ids + [0]
        assert len(words.words[0]) + len(words.late[0]) <= 60


def test_repeated_rows_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "same text", None)] * 5 + [(None, "no id", None)], SCHEMA)
    rows = packing.pack(docs).collect()
    assert len(rows) == 6 and len(check(rows)) == 1
    assert packing.pack(docs.limit(0)).collect() == []


def test_several_groups_and_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    docs = spark.createDataFrame([(i, "w " * (1 + i * 37 % 900), None) for i in range(300)], SCHEMA)
    rows = packing.pack(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    total = sum(r["length"] for r in rows)
    assert len(check(rows)) <= 1.1 * total / packing.CAPACITY + 1


def test_genetic_steps_keep_every_item():
    rng = np.random.default_rng(3)
    lens = rng.integers(1, 1500, 400).tolist()
    for seed in range(3):
        bins = packing.evolve(lens, seed, stall=3)
        assert sorted(i for b in bins for i in b) == list(range(400))
        assert max(sum(lens[i] for i in b) for b in bins) <= packing.CAPACITY
    import random

    first = packing._Bins(packing.CAPACITY)
    first.best_fit(range(400), lens)
    child = packing._cross(first.bins, bins, lens, packing.CAPACITY, random.Random(1))
    assert sorted(i for b in child for i in b) == list(range(400))
    hard = [1100] * 7 + [900] * 7
    assert len(packing.evolve(hard, 1)) == 7
    assert pd.Series([len(b) for b in packing.evolve([2047, 1, 2046, 2], 0)]).tolist() == [2, 2]


def triplets(seed, n=40):
    """Pieces that fill n sequences exactly, three in each."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = int(r.integers(520, 850))
        b = int(r.integers(520, min(850, packing.CAPACITY - a - 400)))
        out += [a, b, packing.CAPACITY - a - b]
    return r.permutation(out).tolist()


def test_evolution_beats_best_fit_decreasing():
    for seed in range(4):
        lens = triplets(seed)
        plain, found = packing.best_fit_decreasing(lens), packing.evolve(lens, seed, stall=20)
        assert sorted(i for b in found for i in b) == list(range(len(lens)))
        assert max(sum(lens[i] for i in b) for b in found) <= packing.CAPACITY
        assert 40 <= len(found) < len(plain)


def test_migration_hands_on_the_better_packing():
    lens = triplets(9)
    good = packing.evolve(lens, 1, stall=20)
    assert len(packing.evolve(lens, 2, [packing.best_fit_decreasing(lens), good], stall=0)) == len(good) < len(packing.best_fit_decreasing(lens))


def test_another_tokenizer(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing._wordwise(tokenizers.Tokenizer.from_file(path))
    assert packing._wordwise(tokenizers.Tokenizer.from_file(packing.default_tokenizer()))
    t = tokenizers.Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(ODD)], SCHEMA)
    got = {r.doc_id: r.ids for r in packing.tokenized(docs, path, ids=True).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(ODD)}
    check(packing.pack(docs, path).collect())


def test_islands_work_where_best_fit_falls_short(spark, monkeypatch):
    """Texts whose lengths are triplets, through the whole operator."""
    monkeypatch.setattr(packing, "GROUP", 240)
    lens = triplets(5, 80)
    word = "the "
    docs = spark.createDataFrame([(i, word * (n - 1), None) for i, n in enumerate(lens)], SCHEMA)
    rows = packing.pack(docs).collect()
    assert sorted(r.length for r in rows) == sorted(lens)
    assert 80 <= len(check(rows)) < len(packing.best_fit_decreasing(lens))
