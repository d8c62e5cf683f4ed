"""Language identification by Bayesian evidence fusion.

1. Text: a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of each language's labelled documents, gives each text
   a log likelihood per language, tempered because trigrams overlap.
2. A first guess from the text alone is counted by host, domain, address suffix and declared language, by grouped aggregation
   over the whole table. Host priors are smoothed towards their domain's, and these towards the table's: a host with n
   pages keeps n / (n + STRENGTH) of its own counts. Suffix and declared markup language enter as likelihoods with
   add-one smoothing; so a declaration counts as far as declarations are right in these data.
3. The posterior is the normalised product.

Defined results: null and empty texts have no text evidence and follow the rest. A missing declaration, suffix or host gives no
evidence of its own. Repeated rows are judged each by itself and count as often as they occur. Of equally likely languages the
first by name is taken. Very long texts are read whole. Extra columns are id columns and pass through, but for the names that
the result has itself. An empty table gives an empty result; without labelled text every language is null.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import textkit as T
from twinsift.llm.shared import cut, salted
from twinsift.llm.urls import host_of

NAME = "op6_language_id"
SQL = None

#: Labelled documents of each language that the model is fitted on (the expected number, where there are more).
SAMPLE = 1000
BUCKETS = 1 << 13
#: Trigrams of a text count as this many independent ones at most.
INDEPENDENT = 60.0
STRENGTH = 8.0
#: A language is taken as known from this posterior on.
CONFIDENT = 0.5

_HTML = r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<[^>]*>"


def _trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each three bytes in a row of a text, and where each text's begin; ASCII letters in lower case."""
    b = T.LOWER[buf].astype(np.uint32)
    n = np.maximum(np.diff(off) - 2, 0)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(n)])
    g = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(19)
    ok = np.ones(len(g), bool)
    for d in (1, 2):
        at = off[1:] - d
        ok[at[(at >= 0) & (at < len(g)) & (at >= off[:-1])]] = False
    return g[ok].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram bucket in each. labelled: doc_id, text, lang. Every language that labels
    a row is known; the model holds BUCKETS numbers for each."""
    some = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    # of each language by a bound on the id's hash, so that no task gathers the sample
    share = some.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.count("*")).alias("_share"))
    share = F.broadcast(labelled.sparkSession.createDataFrame([tuple(r) for r in share.collect()], "lang string, _share double"))
    sample = some.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))

    def run(frames):
        for f in frames:
            for part in T.batches(f, "text"):
                g, at = _trigrams(*T.flat(part.column("text")))
                code = part.column("lang").dictionary_encode()
                lang = np.repeat(code.indices.to_numpy(), np.diff(at))
                both, n = np.unique(lang.astype(np.int64) * BUCKETS + g, return_counts=True)
                yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(both // BUCKETS)), pa.array(both % BUCKETS), pa.array(n)], ["lang", "g", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for lang, g, n in counted.collect():  # at most BUCKETS rows for each language
        counts.setdefault(lang, np.zeros(BUCKETS))[g] = n
    langs = sorted(counts)
    table = np.array([np.log((counts[x] + 0.1) / (counts[x].sum() + 0.1 * BUCKETS)) for x in langs]).T if langs else np.zeros((BUCKETS, 0))
    return langs, np.ascontiguousarray(table)


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows (with text and, for pages, markup true) with ll, the tempered log likelihood of each language, for text."""
    keep = [c for c in rows.columns if c not in ("text", "markup")]
    n_langs = table.shape[1]

    def run(frames):
        for f in frames:
            for part in T.batches(f, "text"):
                text, markup = part.column("text"), part.column("markup")
                bare = pc.replace_substring_regex(text, _HTML, " ")
                g, at = _trigrams(*T.flat(pc.if_else(markup, bare, text)))
                n = np.diff(at)
                ll = np.zeros((len(n), n_langs))
                some = np.flatnonzero(n)
                if len(some):
                    ll[some] = np.add.reduceat(table[g], at[some], axis=0)
                    ll[some] *= (np.minimum(1.0, INDEPENDENT / n[some]))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n_langs, pa.int32()), pa.array(ll.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], [*keep, "ll"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep) + ", ll array<double>"
    return rows.mapInArrow(run, schema)


def _best(scores: Column) -> Column:
    """The place of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def identify(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """rows (id columns, text, markup, declared, host) with language, confidence, text_language and declared."""
    n = len(langs)
    own = ("language", "confidence", "text_language", "domain", "suffix", "guess", "ll", "score", "prior", "declared_ll", "suffix_ll")
    rows = rows.drop(*own)
    ids = [c for c in rows.columns if c not in ("text", "markup", "host", "declared")]
    if not n:
        return rows.select(*ids, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), "declared")
    labels = F.array(*map(F.lit, langs))
    host = F.col("host")
    seen = rows.withColumns({"domain": F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), "suffix": F.when(host.contains("."), F.substring_index("host", ".", -1))})
    first = cut(text_evidence(seen, table).withColumn("guess", F.when(F.array_max("ll") < 0, _best(F.col("ll")))))

    def counts(key: str, name: str) -> DataFrame:
        one = F.array(*[F.count(F.when(F.col("guess") == k, 1)) for k in range(n)])
        return first.where(F.col(key).isNotNull()).groupBy(key).agg(one.alias(name))

    total = first.agg(F.array(*[F.count(F.when(F.col("guess") == k, 1)) for k in range(n)]).alias("x")).first().x
    world = [(c + 1) / (sum(total) + n) for c in total]
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)

    def smoothed(own: Column, parent: Column) -> Column:
        return F.zip_with(own, parent, lambda x, p: (x + STRENGTH * p) / (size(own) + F.lit(STRENGTH)))

    zero = F.array(*[F.lit(0).cast("long")] * n)
    domains = counts("domain", "dc").select("domain", smoothed(F.col("dc"), F.array(*map(F.lit, world))).alias("dp"))
    per_lang = F.array(*[F.lit(c) for c in total])
    like = lambda c: F.zip_with(c, per_lang, lambda x, t: F.log((x + 1.0) / (t + 2.0)))
    declared = counts("declared", "kc").select("declared", like(F.col("kc")).alias("declared_ll"))
    suffixes = counts("suffix", "sc").select("suffix", like(F.col("sc")).alias("suffix_ll"))
    # what is known of a host and a declaration is put together once, and meets the rows in one join
    kinds = first.select("host", "domain", "suffix", "declared").distinct()
    for table, key in ((counts("host", "hc"), "host"), (domains, "domain"), (declared, "declared"), (suffixes, "suffix")):
        kinds = salted(kinds, table, key, F.concat_ws("/", "host", "declared"))
    prior = smoothed(F.coalesce("hc", zero), F.coalesce("dp", F.array(*map(F.lit, world))))
    # null keys as texts that no host or declaration can be
    both = lambda: F.concat_ws("\n", F.coalesce("host", F.lit("\r")), F.coalesce("declared", F.lit("\r")))
    known = kinds.select(both().alias("_kind"), prior.alias("prior"), "declared_ll", "suffix_ll")
    joined = salted(first.withColumn("_kind", both()), known, "_kind", F.monotonically_increasing_id())
    none = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(F.col("ll"), F.transform("prior", lambda p: F.log(p))), add(F.coalesce("declared_ll", none), F.coalesce("suffix_ll", none)))
    joined = joined.withColumn("score", score)
    z = F.aggregate(F.transform("score", lambda s: F.exp(s - F.array_max("score"))), F.lit(0.0), lambda a, x: a + x)
    return joined.select(*ids, F.get(labels, _best(F.col("score"))).alias("language"), (1 / z).alias("confidence"), F.get(labels, F.col("guess")).alias("text_language"), "declared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and documents with their declared language and their source as host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    langs, table = fit(docs.select("doc_id", "text", "lang"))
    none = F.lit(None)
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    p = pages.select(none.cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), F.lit(True).alias("markup"), F.when(declared != "", declared).alias("declared"), F.when(host_of(F.col("url")) != "", host_of(F.col("url"))).alias("host"))
    d = docs.select("doc_id", none.cast("long").alias("page_id"), "text", F.lit(False).alias("markup"), F.lower("lang").alias("declared"), F.col("source").alias("host"))
    got = identify(p.unionAll(d), langs, table)
    return got.select("doc_id", "page_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", "declared", (F.col("confidence") >= CONFIDENT).alias("kept"))
