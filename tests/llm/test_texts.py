"""Substring, near and line dedup, quality rules against plain Python."""

import random

import pytest

from tests.llm import brute
from twinsift.llm import linedup, neardup, quality, substrings

SCHEMA = "doc_id long, text string, n_words string, kept string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], SCHEMA)


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, odd texts and one long one."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocab) + r.choice(["", "", "", ".", "\n", "\t"]) for _ in range(k))
    passages = [text(60) for _ in range(3)]
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not docs:
            docs.append(text(r.randint(5, 200)))
        elif kind == 1:
            docs.append(docs[r.randrange(len(docs))])
        elif kind == 2:
            w = docs[r.randrange(len(docs))].split(" ")
            w[r.randrange(len(w))] = "changed"
            docs.append(" ".join(w))
        elif kind == 3:
            docs.append(text(40) + "\n" + r.choice(passages) + "\n" + text(30))
        else:
            docs.append(text(r.randint(0, 120)))
    docs += ["", None, "  \n\t ", "one", "ONE", "a b c", "A B C", "x " * 3000, "x " * 2990, text(30000), "same\x0bline\x0cwords " * 8]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(10 + i, docs[k]) for i, k in enumerate(order)]


def test_substring_dedup(spark):
    docs = corpus()
    got = substrings.remove_repeats(frame(spark, docs), text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substring_dedup(docs))
    for r in got:
        assert sum(s["to"] - s["from"] for s in r.repeats) == r.n_removed
        assert all(s["to"] - s["from"] >= substrings.LENGTH for s in r.repeats)
        assert len(brute.words(r.kept_text)) == r.n_words - r.n_removed


@pytest.mark.parametrize("limit", [0, 2, 8])
def test_substring_dedup_growing_prefixes(spark, limit):
    """Prefixes that occur more often than the limit grow, some of them to the whole window."""
    docs = corpus(2)
    got = substrings.remove_repeats(frame(spark, docs), limit=limit).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substring_dedup(docs))


def test_substring_dedup_of_a_joined_table(spark):
    docs = corpus(6, 30)
    left = frame(spark, docs).select("doc_id", "n_words")
    right = frame(spark, docs).select("doc_id", "text")
    got = substrings.remove_repeats(left.join(right, "doc_id")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substring_dedup(docs))


def test_subtree_nodes():
    """Windows below a node of depth 13 - j with equal left words, against plain comparison."""
    import numpy as np

    r = random.Random(3)
    stretches, places, least, windows = [], [], [], []
    for i in range(300):
        w = [r.choice("ab") for _ in range(13 + r.randrange(7))]
        n = len(w) - 12
        place = r.randint(n - 1, 6)
        stretches.append(w)
        places.append(place)
        least.append(i // 2)
        windows.append([(place - k, tuple(w[k : k + 13])) for k in range(n)])
    raw = [" ".join(w).encode() for w in stretches]
    bits, n = substrings.subtree(b"".join(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), np.array(least), np.array(places))
    first = {}
    for d, own in zip(least, windows, strict=True):
        for x in own:
            first.setdefault(x, d)
    assert n.tolist() == [len(x) for x in windows]
    assert bits.tolist() == [first[x] < d for d, own in zip(least, windows, strict=True) for x in own]


def test_substring_dedup_ties_nulls_empty(spark):
    t = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"
    docs = [(5, t), (5, t), (None, t), (7, t + " more"), (3, None)]
    got = substrings.remove_repeats(frame(spark, docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute.substring_dedup(docs), key=key)
    assert substrings.remove_repeats(frame(spark, docs).limit(0)).collect() == []


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    docs = corpus(3, 90)
    got = neardup.near_duplicates(frame(spark, docs), words=k).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.near_duplicates(docs, k))


def test_near_duplicates_two_families_in_tiles(spark, monkeypatch):
    """Two families that share bands but no link, in blocks of a few members."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "HELD", 5)
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    docs = []
    for i in range(60):
        v = list(base)
        if i % 2:
            v[80:] = [f"x{k}" for k in range(20)]
        v[r.randrange(75)] = f"n{i}"
        docs.append((i, " ".join(v)))
    got = neardup.near_duplicates(frame(spark, docs)).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute.near_duplicates(docs))


def test_near_duplicates_chain_and_hot_group(spark, monkeypatch):
    """A chain of near copies whose ends aren't alike, and many copies of two families that share bands."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    docs, w = [], list(base)
    for i in range(40):
        w = list(w)
        at = r.randrange(110)
        w[at : at + 2] = [f"c{i}a", f"c{i}b"]
        docs.append((i, " ".join(w)))
    for i in range(40, 120):
        v = list(base)
        for _ in range(r.choice([1, 3, 6, 9])):
            v[r.randrange(120)] = f"n{r.randrange(10**6)}"
        docs.append((i, " ".join(v)))
    got = neardup.near_duplicates(frame(spark, docs)).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute.near_duplicates(docs))


def test_near_duplicates_nulls_repeats_empty(spark):
    t = "a b c d e f g"
    rows = neardup.near_duplicates(frame(spark, [(4, t), (4, t), (2, t.upper()), (None, t), (9, None), (8, "")])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == sorted([(4, 2, False), (4, 2, False), (2, 2, True), (None, None, True), (9, 9, True), (8, 8, True)], key=str)
    assert neardup.near_duplicates(frame(spark, []).limit(0)).collect() == []


def test_estimate_is_near_the_truth():
    import numpy as np
    import pyarrow as pa

    from twinsift.llm import textkit as T

    r = random.Random(1)
    a = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    b = a[:2600] + [f"v{i}" for i in range(400)]
    v, at, *_ = neardup.shingles(*T.flat(pa.array([" ".join(a), " ".join(b)])), 5)
    m = neardup._minima(v, at)
    low = (m & np.uint32(15)).astype(np.uint64).reshape(-1, 16, 2)
    sig = (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :, None]).sum(axis=1, dtype=np.uint64).T
    x, y = (set(v[at[i] : at[i + 1]].tolist()) for i in (0, 1))
    assert abs(neardup._estimates(sig[0], sig[1:])[0] - len(x & y) / len(x | y)) < 0.15


def test_line_dedup(spark):
    r = random.Random(7)
    line = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(1, 12)))
    pool = [[line() for _ in range(6)] for _ in range(4)]
    docs = {}
    for i in range(40):
        t = [line() for _ in range(r.randint(0, 8))]
        t += r.choice(pool)[r.randrange(3) :]
        t += [line(), r.choice(t or [""]), ""] + r.choice(pool)
        docs[i] = "\n".join(t)
    docs |= {50: "", 51: None, 52: docs[3], 53: docs[3], 54: "\n".join(line() for _ in range(3000)), 55: "\n\n\n"}
    docs[56] = docs[54]
    got = linedup.dedup_lines(frame(spark, list(docs.items()))).collect()
    assert {x.doc_id: x.text for x in got} == brute.runs_left(docs)
    assert [x for x in got if x.doc_id == 53][0].text == ""
    assert got[0].asDict().keys() == {"doc_id", "text", "n_words", "kept", "n_lines", "n_removed", "n_partners"}


def test_line_dedup_links_runs_by_their_own_first_holder(spark):
    """Lines of a run that occurred earlier in other documents don't hide the document that holds the run."""
    x, y, z = (c * 30 for c in "xyz")
    docs = {1: x, 2: y, 3: z, 4: f"{x}\n{y}\n{z}", 5: f"five\n{x}\n{y}\n{z}\nend"}
    got = {r.doc_id: r.text for r in linedup.dedup_lines(frame(spark, list(docs.items()))).collect()}
    assert got == docs | {5: "five\nend"}


def test_line_dedup_repeated_and_moved_passages(spark):
    x, y, s = "x" * 60, "y" * 60, "s" * 20
    held = f"a\n{y}\n{x}\nb\n{s}\n{s}\n{s}\nz"
    docs = {1: held, 2: f"c\n{x}\nd\n{x}\ne", 3: f"f\n{x}\n{y}\ng", 4: f"h\n{x}\n{y}\ni", 5: f"j\n{s}\n{s}\n{s}\nk\n{s}\n{s}\nl\n{s}\n{s}\n{s}\nm"}
    got = {r.doc_id: r.text for r in linedup.dedup_lines(frame(spark, list(docs.items()))).collect()}
    assert got == {1: held, 2: "c\nd\ne", 3: "f\ng", 4: "h\ni", 5: f"j\nk\n{s}\n{s}\nl\nm"}


def test_line_dedup_leaves_no_run_of_an_earlier_document(spark):
    r = random.Random(13)
    pool = [c * r.choice([3, 12, 24, 49, 50, 70]) for c in "abcdefghijklmn"] + ["", "  "]
    docs = {i: "\n".join(r.choice(pool) for _ in range(r.randint(0, 14))) for i in range(60)}
    got = {x.doc_id: x.text for x in linedup.dedup_lines(frame(spark, list(docs.items()))).collect()}
    assert got == brute.runs_left(docs)


def test_patience_matches_plain_recursion():
    r = random.Random(11)
    for _ in range(200):
        a = [r.randrange(9) for _ in range(r.randrange(14))]
        b = [r.randrange(9) for _ in range(r.randrange(14))]
        mine = [(x + i, y + i) for x, y, n in linedup.patience(a, b) for i in range(n)]
        assert all(a[x] == b[y] for x, y in mine)
        assert mine == sorted(set(mine)) and len({y for _, y in mine}) == len(mine)
        assert mine == brute.patience(a, b)


def test_line_dedup_deals_a_hot_first_document(spark, monkeypatch):
    monkeypatch.setattr(linedup, "PARTNERS", 3)
    monkeypatch.setattr(linedup, "HOLDERS", 3)
    block = "a line that many documents hold and that is long\nand another one of them"
    docs = {i: f"{block}\nown {i}" for i in range(40)}
    got = {x.doc_id: (x.text, x.n_partners) for x in linedup.dedup_lines(frame(spark, list(docs.items()))).collect()}
    assert got == {i: (f"own {i}", 1) if i else (docs[0], 0) for i in docs}


def test_line_dedup_clashing_columns(spark):
    t = "x" * 60
    df = spark.createDataFrame([(1, t, "a", 5, "b"), (2, t + "\ny", "a", 6, "b")], "doc_id long, text string, n_removed string, n_lines long, `a.b` string")
    got = {x.doc_id: x for x in linedup.dedup_lines(df).collect()}
    assert got[2].text == "y" and got[2].n_removed == 1 and got[2]["a.b"] == "b"
    rows = {x.row.doc_id: x for x in linedup.cleaned(df).collect()}
    assert rows[2].row.n_removed == "a" and rows[2].row.n_lines == 6 and rows[2].n_lines == 2


def test_line_dedup_nulls_repeats_empty(spark):
    t = "a long line that is over fifty characters in any case, so it counts\nend"
    rows = linedup.dedup_lines(frame(spark, [(1, t), (1, t), (None, t), (2, t), (3, None)])).collect()
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in rows), key=str) == sorted([(1, t, 0), (1, t, 0), (None, t, 0), (2, "", 2), (3, None, 0)], key=str)
    assert linedup.dedup_lines(frame(spark, []).limit(0)).collect() == []


def test_quality(spark):
    r = random.Random(9)
    docs = corpus(4) + [(900, "the cat " * 30), (901, "# " * 50), (902, " ".join(f"word{i}" for i in range(40))), (903, "dup line here\n" * 9), (904, "a b c d e f g h"), (905, "é" * 10 + "  x")]
    docs += [(910 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for i in range(40)]
    rows = {x.doc_id: x for x in quality.judge(frame(spark, docs)).collect()}
    for d, t in docs:
        x = rows[d]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute.quality(t), d
        assert x.kept == (not x.base_failed and not x.failed_rules)
    kept = quality.filter_documents(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "n_words", "kept"]
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d in rows if rows[d].kept)
    assert quality.judge(frame(spark, docs).limit(0)).collect() == []
    none = quality.judge(frame(spark, [(1, None)])).first()
    assert (none.n_words, none.base_failed, none.kept) == (0, True, False)


def test_quality_filter_works_words_out_once(spark):
    docs = spark.createDataFrame([(1, "the cat sat on it " * 9, "clash", "clash")], SCHEMA)
    plan = quality.filter_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2


def test_quality_plan_is_native(spark):
    plan = quality.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
