"""Components, URL filter, top-k, mixing, tool calls, language and the pipeline."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from twinsift.llm import components, language, mixing, toolcalls, topk, urls


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 90)] + [(5000, 5000), (None, 3), (7000, 6999)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(90)} | {7000: 6999, 6999: 6999}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_random(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


PAGES = [
    (1, "https://a.org/es/x", "<link rel='canonical' href='https://b.info/p'>"),  # blocked by rule; b.info/p is its alias
    (2, "http://b.info/p#frag", None),
    (3, "https://c.info/q?a=1", '<META content="0; URL=//B.info/p" http-equiv=refresh>'),
    (4, "https://example.com/en/7x", "<link href=https://d.info/ rel=canonical>"),  # allowed by rule
    (5, "https://d.info/", '<link rel="canonical" href="https://x.com/en/1">'),  # an alias of an allowed and of a blocked page
    (6, "https://x.com/en/1", ""),
    (7, None, "<link rel=canonical href=https://b.info/p>"),
    (8, "no address", None),
    (9, "ftp://SUB.Example.NET/de/8/y", None),
    (10, "https://example.net/de/9", None),
    (11, "https://notexample.com/en/7", None),
    (12, "https://e.info/1", "<link rel=canonical href=/2>"),
    (13, "https://e.info/2", "<link rel=canonical href='https://a.org/es/x'>"),
    (13, "https://e.info/2", "<link rel=canonical href='https://a.org/es/x'>"),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {
        1: ("a.org", "/es/x", "org/es/", "block"), 2: ("b.info", "/p", None, "block"), 3: ("c.info", "/q", None, "block"),
        4: ("example.com", "/en/7x", "example.com/en/7", "allow"), 5: ("d.info", "/", None, "allow"), 6: ("x.com", "/en/1", "com/en/", "block"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("sub.example.net", "/de/8/y", "example.net/de/8", "block"),
        10: ("example.net", "/de/9", "net/de/", "allow"), 11: ("notexample.com", "/en/7", "com/en/", "block"),
        12: ("e.info", "/1", None, "block"), 13: ("e.info", "/2", None, "block"),
    }
    assert urls.judge(pages).count() == len(PAGES)
    assert urls.judge(pages.limit(0)).collect() == []
    log = spark.createDataFrame([("https://notexample.info/", "https://a.org/es/x")], "a string, b string")
    one = spark.createDataFrame([(1, "https://notexample.info/", None)], "page_id long, url string, html string")
    assert urls.judge(one, more_edges=log).first().verdict == "block"


def test_links_are_resolved_as_on_their_page(spark):
    from urllib.parse import urljoin, urlsplit, urlunsplit

    bases = ["https://h.info/a/b/c.html?x=1", "https://h.info", "https://h.info/", "http://h.info/a/./b/", "https://h.info?x"]
    links = ["p", "./p", "../p", "../../p", "../../../p", "?q=2", "/", "/x/../y", "/x/./y/.", "/x/y/..", "p/../q?z=/../k", "//o.info/k", "https://o.info/m?n", "p#f", "..", "."]
    rows = [(b, x) for b in bases for x in links]
    df = spark.createDataFrame(rows, "base string, link string")
    got = {(r.base, r.link): r.got for r in df.select("base", "link", urls._address(urls._resolved(F.col("base"), F.col("link"))).alias("got")).collect()}
    for b, x in rows:
        # a base without a path is its root
        whole = urlsplit(b)
        want = urlsplit(urljoin(urlunsplit(whole._replace(path=whole.path or "/")), x))
        assert got[b, x] == want.netloc + (want.path or "/") + ("?" + want.query if want.query else ""), (b, x)
    none = spark.createDataFrame([("https://h.info/", "mailto:x@y"), ("no address", "p"), ("https://h.info/", "javascript:void(0)")], "base string, link string")
    assert [r[0] for r in none.select(urls._resolved(F.col("base"), F.col("link"))).collect()] == [None] * 3
    page = "<base href='/k/'><link rel=canonical href='p'>"
    edges = urls.alias_edges(spark.createDataFrame([("https://h.info/a/b", page)], "url string, html string")).collect()
    assert [tuple(r) for r in edges] == [("h.info/a/b", "h.info/k/p")]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_top_k(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) * (1 + i % 5) for _ in range(24)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, [float("nan")] * 24), (502, [None] + [0.1] * 23), (503, []), (504, [float("inf")] * 24), (505, [1.0, 2.0]), (520, [2.0, 1.0]), (540, [0.0] * 24), (None, [0.5] * 24)]
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    v = topk.whole_vectors(vectors(spark, rows))
    got = sorted(tuple(x) for x in topk.top_k(v, v.where("vec_id % 20 = 0")).collect())
    import numpy as np

    whole = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in whole:
        if q % 20 == 0:
            score = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(score[:20])]
    assert got == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).collect() == []


@pytest.mark.parametrize("size", [2.0**-4, 3e5, 5e6, 1.3e7])
def test_top_k_is_exact_at_any_size(spark, size):
    """Doubles, 64-bit integers, and Python's integers; the scores are those of plain Python."""
    import numpy as np

    r = random.Random(8)
    rows = [(i, [float(np.float32(r.choice([-1, 1]) * size * r.random())) for _ in range(16)]) for i in range(60)]
    rows += [(60 + i, rows[5][1]) for i in range(30)]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(x) for x in topk.top_k(v, v.where("vec_id % 20 = 0")).collect())
    whole = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    want = []
    for q in whole:
        if q % 20 == 0:
            score = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q)
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(score[:20])]
    assert got == sorted(want)


def test_top_k_says_what_it_cannot_hold(spark):
    huge = spark.createDataFrame([(i, [1e9, 1e9]) for i in range(0, 60, 20)], "vec_id long, embedding array<double>")
    v = topk.whole_vectors(huge)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(v, v).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.whole_vectors(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_search_prunes_and_stays_exact():
    import numpy as np

    r = np.random.default_rng(1)
    c = (r.normal(size=(3000, 32)) * np.linspace(60, 1, 32)).astype(np.int64)
    q = (r.normal(size=(20, 32)) * np.linspace(60, 1, 32)).astype(np.int64)
    a, b, s = topk.search(np.arange(20) + 10**6, q, np.arange(3000)[::-1].copy(), c, np.zeros(20, np.int64), np.zeros(20, bool))
    full = q @ c.T
    for i in range(20):
        want = sorted((-full[i, j], 2999 - j) for j in range(3000))[:20]
        assert sorted((-x, y) for x, y in zip(s[a == i], b[a == i], strict=True)) == want


def sources(spark, sizes, words=20):
    rows = [(s * 100000 + i, f"s{s}" if s else None, " ".join(["w"] * words), "x") for s, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, epoch string")


def test_exponent_meets_its_targets(spark):
    d = sources(spark, [1000, 300, 100]).select("doc_id", "source", mixing.tokens_of().alias("_tokens"))
    table = mixing.source_table(d)
    total = 1400 * 20
    a = mixing.find_exponent(table, total, max_epochs=2.0)
    assert abs(10 ** (1 - a) - 2) < 1e-4
    h = lambda a: (lambda w: -sum(x / sum(w) * math.log(x / sum(w)) for x in w))([(x / 1400) ** a for x in (1000, 300, 100)])
    a = mixing.find_exponent(table, total, entropy=1.0)
    assert abs(h(a) - 1.0) < 1e-5
    assert mixing.find_exponent(table, total, max_epochs=100.0) == 0.0
    a = mixing.find_exponent(table, total, max_epochs=3.0, budget=float(total))
    w = [(x / 1400) ** a for x in (1000, 300, 100)]
    assert abs(w[2] / sum(w) * 1400 / 100 - 3) < 1e-4


def test_mix_realises_the_weights(spark):
    got = mixing.mix(sources(spark, [3000, 900, 300])).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert set(r.doc_id for r in got) == {s * 100000 + i for s, n in enumerate([3000, 900, 300]) for i in range(n)}
    for s, n in ((None, 3000), ("s1", 900), ("s2", 300)):
        want = by[s][0].epochs * n
        assert abs(len(by[s]) - want) < 0.05 * want + 2
        assert len({(r.doc_id, r.n_tokens) for r in by[s]}) == n
    share = sum(r.n_tokens for r in by["s2"]) / sum(r.n_tokens for r in got)
    assert abs(share - by["s2"][0].weight) < 0.01
    again = mixing.mix(sources(spark, [3000, 900, 300]).repartition(7)).collect()
    assert sorted((r.doc_id, r[4:]) for r in got) == sorted((r.doc_id, r[4:]) for r in again)


def test_mix_under_a_budget_and_odd_input(spark):
    got = mixing.mix(sources(spark, [2000, 500]), budget=10000.0, max_epochs=None, entropy=0.65)
    assert abs(got.agg(F.sum("n_tokens")).first()[0] - 10000) < 400
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "a", "", "x"), (3, "a", "b c", "x"), (3, "a", "b c", "x")], "doc_id long, source string, text string, epoch string")
    assert {1, 2, 3} == {r.doc_id for r in mixing.mix(odd).collect()}
    assert mixing.mix(odd.limit(0)).collect() == []
    assert {r.doc_id for r in mixing.mix(odd.limit(2)).collect()} == {1, 2}


def xx(seed, *values):
    """Spark's xxhash64 chained over values, by the xxhash library."""
    import xxhash

    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if not isinstance(v, bool) else b""
            seed = xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def int4(seed, v):
    import xxhash

    return xxhash.xxh64_intdigest(v.to_bytes(4, "little", signed=True), seed)


def brute_mix(docs, max_epochs=2.0, seed=mixing.SEED, block=mixing.BLOCK):
    """[(doc_id, source, epoch)], by plain Python: the exponent by bisection, blocks by hash, budgets a block."""
    tokens = [len(brute.words(t)) for _, _, t in docs]
    total = {}
    for (_, s, _), n in zip(docs, tokens, strict=True):
        total[s or ""] = total.get(s or "", 0) + n
    every = sum(total.values())
    share = {s: n / every for s, n in total.items() if n}

    def repeats(a):
        return max(p ** (a - 1) for p in share.values()) / min(p ** (a - 1) for p in share.values())

    low, high = 0.0, 1.0
    if repeats(0.0) <= max_epochs:
        high = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= max_epochs else (mid, high)
    least = min(p ** (high - 1) for p in share.values())
    epochs = {s: share[s] ** (high - 1) / least if s in share else 1.0 for s in total}
    epochs = {s: round(e) if abs(e - round(e)) < 1e-9 else e for s, e in epochs.items()}
    blocks = max(1, -(-len(docs) // block))
    held = {}
    for (d, s, t), n in zip(docs, tokens, strict=True):
        h = signed(xx(int4(42, seed), d, t))
        held.setdefault((s or "", h % blocks), []).append((h, d, n))
    out = []
    for (s, b), rows in held.items():
        whole = int(epochs[s])
        offset = (signed(int4(xx(42, s, b), seed)) % 2**30 + 0.5) / 2**30
        rows.sort(key=lambda r: (signed(int4(xx(42, r[0]), whole)), r[0]))
        sum_, before = sum(n for *_, n in rows), 0
        for k, (_, d, n) in enumerate(rows):
            more = before + offset * n < (epochs[s] - whole) * sum_ if sum_ else k + offset < (epochs[s] - whole) * len(rows)
            before += n
            out += [(d, s, e) for e in range(whole + more)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [[300, 90, 31], [700, 700], [40, 900, 7, 200]])
def test_mix_against_plain_python(spark, sizes, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    r = random.Random(sum(sizes))
    docs = [(1000 * s + i, f"s{s}" if s else None, " ".join(["w"] * r.randint(0, 9))) for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, text string, weight string")
    got = sorted((x.doc_id, x.source or "", x.epoch) for x in mixing.mix(df).collect())
    assert got == brute_mix(docs, block=64)


def test_mix_joins_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    docs = [(1000 * s + i, f"s{s}", "a b c") for s, n in enumerate([50, 20, 3]) for i in range(n)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, text string, weight string")
    assert sorted((x.doc_id, x.source, x.epoch) for x in mixing.mix(df).collect()) == brute_mix(docs)
    kept = mixing.taken(df).first()
    assert kept.row.weight == "x" and kept.weight != "x"


def call(i, name, args, **more):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': args} | more)}</tool_call>"


def result(i, content):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "first " + call("a", "search", {"query": "é", "limit": 3}) + call("b", "fetch", {"url": {"$result": "a"}})),
        (1, 2, "tool", result("a", [1, 2]) + result("zz", 0)),
        (1, 3, "assistant", call("c", "calculate", {"expression": 5}, after=["b"]) + call("a", "search", {"query": "again"})),
        (1, 4, "tool", result("b", {"y": 1, "x": 2}) + result("c", 1)),
        (2, 0, "assistant", call("a", "store", {"key": "k", "value": None}, after=["b"]) + call("b", "store", {"value": 1}, after=["a"])),
        (2, 1, "tool", result("a", 1) + result("b", 2)),
        (3, 0, "tool", result("e", 1)),
        (3, 1, "assistant", call("e", "fetch", {"url": "u", "x": 1})),
        (4, 0, "assistant", "<tool_call>{nope</tool_call>"),
        (4, 1, "user", None),
        (4, 2, None, ""),
        (None, None, "assistant", call("n", "nothing", {})),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = {(r.conv_id, r.turn, r.seq): r for r in toolcalls.link(df).collect()}
    status = {k: r.status for k, r in got.items()}
    assert status == {
        (1, 0, 0): "text", (1, 1, 0): "text", (1, 1, 1): "ok", (1, 1, 2): "ok", (1, 2, 0): "ok", (1, 2, 1): "orphan", (1, 3, 0): "invalid",
        (1, 3, 1): "duplicate", (1, 4, 0): "ok", (1, 4, 1): "ok", (2, 0, 0): "cycle", (2, 0, 1): "cycle", (2, 1, 0): "ok", (2, 1, 1): "ok",
        (3, 0, 0): "early", (3, 1, 0): "invalid", (4, 0, 0): "malformed", (4, 1, 0): "text", (4, 2, 0): "text", (None, None, 0): "unanswered",
    }
    assert [got[k].level for k in ((1, 1, 1), (1, 2, 0), (1, 1, 2), (1, 4, 0), (1, 3, 0), (1, 4, 1))] == [0, 1, 2, 3, 4, 5]
    assert (got[1, 1, 1].linked_turn, got[1, 1, 1].linked_seq) == (2, 0) and (got[1, 4, 0].linked_turn, got[1, 4, 0].linked_seq) == (1, 2)
    assert got[1, 1, 1].body == '{"role":"assistant","tool_call":{"arguments":{"limit":3,"query":"é"},"id":"a","name":"search"}}'
    assert got[1, 3, 0].errors == ["type:expression"] and got[3, 1, 0].errors == ["unexpected:x"] and got[2, 0, 1].errors == ["missing:key"]
    assert json.loads(got[4, 1, 0].body) == {"content": None, "role": "user"}
    assert toolcalls.link(df.limit(0)).collect() == []


def test_messages_of_the_table(spark):
    """Messages without blocks, against the standard library."""
    raw = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    got = {(r.conv_id, r.turn): r.body for r in toolcalls.query(spark, "/root/testdata/sf0.001").collect()}
    plain = lambda r: '{"content":' + json.dumps(r.text, ensure_ascii=False) + ',"role":' + json.dumps(r.role, ensure_ascii=False) + "}"
    assert got == {(r.conv_id, r.turn): plain(r) for r in raw}


def test_tool_calls_keep_large_ids_and_canonical_json(spark):
    bad = ['{"id":"a","name":"store","arguments":{"key":"k","value":"\\ud800"}}', '{"id":"a","name":"store","arguments":{"key":"k","value":NaN}}', '{"id":"a","name":"store","arguments":{"key":"k","value":1e999}}']
    rows = [(9007199254740993, k, "assistant", f"<tool_call>{x}</tool_call>") for k, x in enumerate(bad)] + [(None, 9007199254740993, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in toolcalls.link(df).collect()}
    assert set(got) == {(9007199254740993, 0), (9007199254740993, 1), (9007199254740993, 2), (None, 9007199254740993)}
    assert [got[9007199254740993, k].status for k in range(3)] == ["malformed"] * 3
    assert [json.loads(got[9007199254740993, k].body)["content"] for k in range(3)] == bad


@pytest.mark.parametrize("whole", [0, 30, 10**6])
def test_levels_of_random_graphs(spark, whole):
    """Longest paths from calls without dependencies; no level in and behind cycles."""
    r = random.Random(12)
    calls = {}
    for c in range(4):
        n = 25
        for i in range(n):
            calls[c, f"c{i}"] = [f"c{r.randrange(i)}" for _ in range(r.randrange(3)) if i] + (["none"] if i % 5 == 0 else [])
        if c % 2:
            calls[c, "c3"] = ["c9"]
            calls[c, "c9"] = ["c3"]
            calls[c, "self"] = ["self"]
    want = {}
    for _ in range(60):
        for (c, i), deps in calls.items():
            need = [d for d in deps if (c, d) in calls]
            if all((c, d) in want for d in need):
                want[c, i] = max((want[c, d] + 1 for d in need), default=0)
    df = spark.createDataFrame([(c, i, d) for (c, i), d in calls.items()], "conv_id long, id string, deps array<string>")
    rows = toolcalls.levels(df, whole).collect()
    assert {(x.conv_id, x.id): x.level for x in rows} == want and len(rows) == len(want)


def test_language_against_plain_python(spark):
    """Every language of the labels is known, however rare; posteriors are those of plain Python."""
    r = random.Random(14)
    letters = {f"l{k:02d}": "".join(r.sample("abcdefghijklmnop", 5)) for k in range(70)}
    text = lambda x, n: " ".join("".join(r.choice(letters[x]) for _ in range(r.randint(2, 6))) for _ in range(n))
    labelled = [(i, text(x, 12), x) for i, x in enumerate([*letters, *["l00"] * 40])]
    langs, table = language.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    assert langs == sorted(letters)

    def grams(t):
        b = t.encode().lower()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 19 for i in range(len(b) - 2)]

    counts = {x: {} for x in langs}
    for _, t, x in labelled:
        for g in grams(t):
            counts[x][g] = counts[x].get(g, 0) + 1
    logp = lambda x, g: math.log((counts[x].get(g, 0) + 0.1) / (sum(counts[x].values()) + 0.1 * language.BUCKETS))
    rows = []
    for i in range(80):
        x = r.choice(langs[:5])
        rows.append((i, r.choice([text(x, 6), text(x, 40), "", None]), r.choice([x, "l00", None]), r.choice(["h.a.de", "h.b.de", "k.b.de", "local", None])))
    df = spark.createDataFrame([(i, t, False, d, h) for i, t, d, h in rows], "id long, text string, markup boolean, declared string, host string")
    got = {q.id: q for q in language.identify(df, langs, table).collect()}

    n, ll, guess = len(langs), {}, {}
    for i, t, *_ in rows:
        g = grams(t or "")
        ll[i] = [sum(logp(x, y) for y in g) * min(1.0, language.INDEPENDENT / len(g)) if g else 0.0 for x in langs]
        guess[i] = max(range(n), key=lambda k: (ll[i][k], -k)) if g else None
    of = {"host": lambda h: h, "domain": lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None, "suffix": lambda h: h.split(".")[-1] if h and "." in h else None}
    seen = {}
    for i, _, d, h in rows:
        for name, v in [("declared", d), *((k, f(h)) for k, f in of.items())]:
            if v is not None:
                one = seen.setdefault((name, v), [0] * n)
                if guess[i] is not None:
                    one[guess[i]] += 1
    total = [sum(guess[i] == k for i in guess) for k in range(n)]
    world = [(c + 1) / (sum(total) + n) for c in total]
    smooth = lambda own, parent: [(x + language.STRENGTH * p) / (sum(own) + language.STRENGTH) for x, p in zip(own, parent, strict=True)]
    for i, _, d, h in rows:
        domain = of["domain"](h)
        parent = smooth(seen["domain", domain], world) if domain else world
        prior = smooth(seen["host", h] if h else [0] * n, parent)
        score = [a + math.log(b) for a, b in zip(ll[i], prior, strict=True)]
        for name, v in (("declared", d), ("suffix", of["suffix"](h))):
            if v is not None:
                score = [s + math.log((x + 1) / (t + 2)) for s, x, t in zip(score, seen[name, v], total, strict=True)]
        best = max(score)
        assert abs(got[i].confidence - 1 / sum(math.exp(s - best) for s in score)) < 1e-9
        assert score[langs.index(got[i].language)] > best - 1e-9
        assert got[i].text_language == (None if guess[i] is None else langs[guess[i]])


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    langs, table = language.fit(docs.where("doc_id % 2 = 0"))
    assert langs == ["de", "en", "es", "fr"]
    rows = docs.where("doc_id % 2 = 1 AND n_chars > 200").select("doc_id", "lang", "text", F.lit(False).alias("markup"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    got = language.identify(rows, langs, table).agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert got > 0.97


def test_language_fuses_evidence(spark):
    """Texts that say nothing follow their host, and a declaration that is usually right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = language.fit(docs)
    text = {x: docs.where(F.col("lang") == x).orderBy("doc_id").first().text for x in langs}
    rows = [(f"{x}{i}", text[x], False, x, f"h.{x}.example") for x in langs for i in range(20)]
    rows += [("null", None, False, None, "h.de.example"), ("declared", "", False, "fr", None), ("none", None, False, None, None), ("page", f"<p lang=x>{text['es']}</p><script>the of and</script>", True, None, None)] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, markup boolean, declared string, host string, language string").drop("language")
    got = {r.id: r for r in language.identify(df, langs, table).collect()}
    assert got["null"].language == "de" and got["declared"].language == "fr" and got["page"].language == "es"
    assert got["none"].language is not None and got["none"].confidence < 0.5 and got["none"].text_language is None
    assert language.identify(df, langs, table).count() == len(rows)
    assert language.identify(df.limit(0), langs, table).collect() == []
    empty = language.fit(docs.limit(0))
    assert language.identify(df, *empty).first().language is None


def test_pipeline_against_plain_python(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from twinsift.llm import quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if rows[r.doc_id].kept}
    for d in left:
        assert rows[d].n_words >= 20 and not brute.quality(left[d])[-1]
    lined = {d: t for d, t in brute.runs_left(left).items() if t == left[d] or brute.words(t)}
    stays = {d for d, _, _, kept in brute.near_duplicates(sorted(lined.items())) if kept}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == stays
    from tests.llm.test_packing import check
    from twinsift.llm.packing import default_tokenizer

    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(default_tokenizer())
    size = {d: len(t.encode(lined[d], add_special_tokens=False).ids) + 1 for d in stays}
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[d] % size[d] == 0 and 1 <= total[d] // size[d] <= 2 for d in stays)
    check(out)


def test_pipeline_deletes_every_run_that_an_earlier_document_holds(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from twinsift.llm import quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: r.text for r in quality.filter_documents(docs).collect()}
    lined = {d: t for d, t in brute.runs_left(left).items() if t == left[d] or brute.words(t)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, quality.filter_documents(docs), sf).collect()} == lined
    stays = {d for d, _, _, kept in brute.near_duplicates(sorted(lined.items())) if kept}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == stays


def test_stages_with_clashing_columns(spark):
    """Each stage on documents that have columns of the names that operators give."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = ["n_removed", "n_lines", "n_partners", "epoch", "epochs", "weight", "n_tokens", "block_order", "position", "kept", "component_id", "n_words", "row", "spans", "first"]
    wide = docs.withColumns({c: F.concat(F.lit("own "), "doc_id") for c in own})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        same = out.where(" AND ".join(f"`{c}` = concat('own ', doc_id)" for c in own))
        assert same.count() == out.count() == stage(spark, docs, "").count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").count() == corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_stages_return_the_columns_of_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.collect() == [], name
