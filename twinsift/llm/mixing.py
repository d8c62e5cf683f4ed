"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by bisection (in
many sections at once, so that few passes over the source table do) to meet a target entropy or a limit on
repetition. Weights are realised as budgeted block permutations: hashing deals the documents of a source into blocks
of about BLOCK documents; an epoch takes each block in an order of its own, and the last, partial epoch takes documents
of that order until the block's share of the token budget is met. A random offset of each block decides on the document
at the edge, so that small blocks are right in the mean. No source meets in one task, whatever its size.

Tokens are words. Defined results: a null source counts as ''. Null and empty texts have 0 tokens and go with their
block. A source without tokens is taken once. Repeated rows count as often as they occur. Documents of
equal hash in a block are taken in any order, which can't be told from the result. Very long texts are counted whole and
never cut. Extra columns pass through; taken() keeps any names apart, and mix() puts its own columns in the place of those with
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsift.llm.shared import SPLIT, cut, trimmed

NAME = "op2_source_mixing"
SQL = None

BLOCK = 512
MAX_EPOCHS = 2.0
SEED = 17
#: Sources up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def tokens_of(text="text"):
    bare = trimmed(F.coalesce(F.col(text), F.lit("")))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPLIT, -1))).cast("long")


def source_table(docs: DataFrame) -> DataFrame:
    """source, docs, tokens and share of each source."""
    each = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(F.count("*").alias("_docs"), F.sum("_tokens").alias("_total"))
    return cut(each)


def _measure(sources: DataFrame, total: float, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """Entropy and largest repetition at each exponent, in one pass."""
    p = F.col("_total") / F.lit(float(total))
    aggs = []
    for a in exponents:
        aggs += [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1))), F.min(F.pow(p, F.lit(a - 1)))]
    row = sources.where("_total > 0").agg(*[x.alias(f"x{i}") for i, x in enumerate(aggs)]).first()
    out = []
    for i, a in enumerate(exponents):
        z, s, high, low = row[4 * i : 4 * i + 4]
        out.append((math.log(z) - a * s / z, high / low if budget is None else high * budget / (total * z)))
    return out


def find_exponent(sources: DataFrame, total: float, entropy: float | None = None, max_epochs: float | None = None, budget: float | None = None, sections: int = 16, passes: int = 12) -> float:
    """The smallest exponent in [0, 1] with an entropy of at most `entropy`, or a repetition of at most max_epochs.

    Entropy (in nats) and, at a given or a one-epoch budget, repetition fall as the exponent rises. 1 where even that is above.
    """
    low, high = 0.0, 1.0
    for n in range(passes):
        tries = [low + (high - low) * k / sections for k in range(0 if n == 0 else 1, sections)]
        got = _measure(sources, total, tries, budget)
        good = [(h <= entropy if entropy is not None else r <= max_epochs * (1 + 1e-12)) for h, r in got]
        k = next((k for k, ok in enumerate(good) if ok), None)
        if n == 0 and k == 0:
            return 0.0
        step = (high - low) / sections
        if k is None:
            low = tries[-1]
        else:
            low, high = max(low, tries[k] - step), tries[k]
    return high


def taken(docs: DataFrame, entropy: float | None = None, max_epochs: float | None = MAX_EPOCHS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """row, a struct of docs' columns, as often as its source's weight asks, with n_tokens, weight, epochs, epoch, block_order
    and position.

    Without a budget (in tokens) the mix is the smallest that holds every document once at least. block_order and position
    give the order in which the blocks and their documents are taken.
    """
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce("source", F.lit("")).alias("source"), tokens_of().alias("_tokens"), F.col("doc_id"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    sources = source_table(d)
    n_sources, total, n_docs = sources.agg(F.count("*"), F.sum("_total"), F.sum("_docs")).first()
    total, n_docs = float(total or 0), n_docs or 0
    if total:
        a = find_exponent(sources, total, entropy, max_epochs, budget)
        p = F.col("_total") / F.lit(total)
        z, low = sources.where("_total > 0").agg(F.sum(F.pow(p, F.lit(a))), F.min(F.pow(p, F.lit(a - 1)))).first()
        weight = F.when(F.col("_total") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(0.0)
        scale = 1 / low if budget is None else budget / (total * z)
        epochs = F.when(F.col("_total") > 0, F.pow(p, F.lit(a - 1)) * F.lit(scale)).otherwise(1.0)
    else:
        weight, epochs = F.lit(0.0), F.lit(1.0)
    # what rounding leaves within 1e-9 of a whole number is one
    weights = sources.select(F.col("_source").alias("source"), weight.alias("weight"), F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs).alias("epochs"))
    if n_sources <= BROADCAST_SOURCES:
        d = d.join(F.broadcast(weights), "source")
    else:
        # a source of any size is dealt over SALTS tasks
        d = d.withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int"))
        d = d.join(weights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["source", "_salt"])
    blocks = max(1, -(-n_docs // BLOCK))
    d = d.withColumn("_block", F.pmod("_h", F.lit(blocks)))
    last = F.floor("epochs").cast("int")
    order = F.xxhash64("_h", last)
    w = Window.partitionBy("source", "_block").orderBy(order, "_h")
    before = F.coalesce(F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_tokens").over(Window.partitionBy("source", "_block"))
    offset = (F.pmod(F.xxhash64("source", "_block", F.lit(seed)), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    more = before + offset * F.col("_tokens") < (F.col("epochs") - last) * whole
    # a block without tokens goes by rows
    rows = F.row_number().over(w) - 1 + offset < (F.col("epochs") - last) * F.count("*").over(Window.partitionBy("source", "_block"))
    d = d.withColumn("_n", last + F.when(whole > 0, more).otherwise(rows).cast("int")).where("_n > 0")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.select(F.col("_row").alias("row"), F.col("_tokens").alias("n_tokens"), "weight", "epochs", "epoch", F.xxhash64("source", "_block", "epoch", F.lit(seed)).alias("block_order"), F.xxhash64("_h", "epoch").alias("position"))


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """taken() with docs' columns apart; its own columns replace those with their names."""
    own = ["n_tokens", "weight", "epochs", "epoch", "block_order", "position"]
    return taken(docs, *args, **options).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in own], *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "n_tokens", "weight", "epochs", "epoch", "block_order", "position")
