"""Captions: pairing with images and packing into parts of bounded tokens, as one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.paths import base, extension, flatten

BUDGET = 75
SEPARATOR = ", "
#: A stand-in for a tokenizer: runs of letters and digits and single other characters, and two special tokens.
STAND_IN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \n\t]"


class CollisionError(ValueError):
    """Different paths flatten to one name."""


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(STAND_IN), F.lit(0))) + 2


#: Token counters by the name of the model whose tokens they count; others are added here.
COUNTERS: dict[str, Callable[[Column], Column]] = {"stand-in": count_tokens}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pairs(files: DataFrame, texts: DataFrame) -> DataFrame:
    """rel_path and caption of every file with a .txt of its base name beside it. texts: rel_path, content."""
    images = files.where(F.lower(extension(F.col("rel_path"))) != ".txt").select("rel_path", base(F.col("rel_path")).alias("base"))
    notes = texts.where(F.col("rel_path").endswith(".txt")).select(base(F.col("rel_path")).alias("base"), strip(F.col("content")).alias("caption"))
    return images.join(notes, "base").select("rel_path", "caption")


def parts_of(caption: Column, count: Callable[[Column], Column] = count_tokens, budget: int = BUDGET) -> Column:
    """The parts of a caption, in order. A caption within the budget is one part, unchanged. Otherwise its pieces between
    separators are taken while their tokens, and one for each separator, fit; a piece that doesn't fit begins the next
    part, and the first piece too, so that an empty part can come first. A piece over the budget is a part of its own."""
    first = F.struct(F.array().cast("array<int>").alias("breaks"), F.lit(0).alias("n"))

    def step(s, x):
        fits = s["n"] + x["n"] + 1 <= budget
        return F.struct(F.when(fits, s["breaks"]).otherwise(F.concat(s["breaks"], F.array(x["i"]))).alias("breaks"), F.when(fits, s["n"] + x["n"] + 1).otherwise(x["n"]).alias("n"))

    def packed(words):
        # only where parts begin is carried along; the parts are cut out at the end
        sized = F.transform(words, lambda w, i: F.struct(i.alias("i"), count(w).alias("n")))
        breaks = F.aggregate(sized, first, step, lambda s: s["breaks"])
        ends = F.transform(F.array(breaks), lambda b: F.zip_with(F.concat(F.array(F.lit(0)), b), F.concat(b, F.array(F.size(words))), lambda x, y: F.array_join(F.slice(words, x + 1, y - x), SEPARATOR)))
        return ends[0]

    split = F.transform(F.array(F.split(caption, SEPARATOR, -1)), packed)[0]
    return F.when(count(caption) <= budget, F.array(caption)).when(caption.isNotNull(), split)


def chunks(captions: DataFrame, key: str = "rel_path", caption: str = "caption", count: Callable[[Column], Column] = count_tokens, budget: int = BUDGET) -> DataFrame:
    """key, pos and text: a row for each part."""
    parts = captions.select(key, parts_of(F.col(caption), count, budget).alias("parts"))
    return parts.select(key, F.posexplode("parts").alias("pos", "text"))


def metadata(captions: DataFrame, count: Callable[[Column], Column] = count_tokens, budget: int = BUDGET) -> DataFrame:
    """file_name (flattened) and text: a row for each part."""
    return chunks(captions, count=count, budget=budget).select(flatten(F.col("rel_path")).alias("file_name"), "text")


def collisions(files: DataFrame) -> DataFrame:
    """file_name and n of names that several paths flatten to."""
    return files.groupBy(flatten(F.col("rel_path")).alias("file_name")).agg(F.count_distinct("rel_path").alias("n")).where("n > 1")


def require_distinct_names(files: DataFrame) -> DataFrame:
    bad = collisions(files).limit(3).collect()
    if bad:
        raise CollisionError(", ".join(r.file_name for r in bad))
    return files
