"""Quality rules: a threshold table compiled into one Spark projection; DataFrame functions only.

measures() gives the counts of each text, RULES the bounds on ratios of these counts, and verdict() turns the
table into one boolean column. Nothing is shuffled: every count is worked out inside its row.

Defined results: a null, empty or white-space text has no words, all counts 0, base_failed true and kept false. Repeated
rows and repeated ids are judged each by itself. Extra columns are left out of the result; a clashing name
among them (such as n_words) is not read. Very long texts are measured whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.shared import SPLIT, WHITE, trimmed

NAME = "op9_quality_rules"

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is was for on it this are "
    "der die das und in zu den von mit ist ein eine nicht auf für "
    "le la les de des et un une du en est que dans pour au aux "
    "el los las y es por para con se su del al como no"
).split()

#: As they are written inside a sentence and at its start.
_WRITTEN = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})

#: (rule, ratio's numerator, ratio's denominator, least, most), over measures(); a ratio with denominator 0 passes. A
#: bound None doesn't apply.
RULES = (
    ("length", "n_words", None, 20, None),
    ("word_length", "word_chars", "n_words", 1.5, 25),
    ("symbols", "n_symbols", "n_words", None, 0.25),
    ("stop_words", "n_stop_words", "n_words", 0.01, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, n: Column) -> Column:
    """Words that lie in a window of WINDOW words which the same text holds twice or more."""
    pair = lambda a, b: F.xxhash64(a, b)

    def shifted(h: Column, by: int) -> Column:
        return _let(h, lambda x: F.zip_with(x, F.slice(x, by + 1, F.greatest(F.size(x), F.lit(1))), pair))

    once = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.slice(shifted(shifted(shifted(once, 1), 2), 4), 1, F.greatest(n - (WINDOW - 1), F.lit(0)).cast("int"))

    def places(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(ranked, lambda r: F.filter(r, lambda x, i: (x["h"] == F.get(r, i - 1)["h"]) | (x["h"] == F.get(r, i + 1)["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.when(a.isNull(), F.lit(0)).otherwise(F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_let(places(w), covered)))


def _words(t: Column) -> Column:
    bare = trimmed(t)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT, -1))


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _counts(t: Column, w: Column, lines: Column) -> list[Column]:
    """The counts of a text, its words and its lines, by name."""
    n = F.size(w).cast("long")
    found = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, WHITE, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_repeated(w, n)),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(_WRITTEN))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    return [c.cast("long").alias(name) for name, c in found.items()]


def measures(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and the counts of each text."""
    step = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    step = step.select(*keep, "_t", _words(F.col("_t")).alias("_w"), _lines(F.col("_t")).alias("_l"))
    return step.select(*keep, *_counts(F.col("_t"), F.col("_w"), F.col("_l")))


def failed_base(m=F.col) -> Column:
    return (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))


def failing(rules=RULES, m=F.col) -> Column:
    """Names of the rules that a row of measures() breaks; m gives a measure by name."""
    out = []
    for name, top, bottom, least, most in rules:
        # least <= top / bottom <= most as products: exact, and no division by 0
        low = F.lit(False) if least is None else m(top) < F.lit(float(least)) * (F.lit(1.0) if bottom is None else m(bottom))
        high = F.lit(False) if most is None else m(top) > F.lit(float(most)) * (F.lit(1.0) if bottom is None else m(bottom))
        some = F.lit(True) if bottom is None else m(bottom) > 0
        out.append(F.when(some & (low | high), F.lit(name)))
    return F.array_compact(F.array(*out))


def passes(text: Column, rules=RULES) -> Column:
    """judge()'s kept as one condition. Words, lines and counts are bound by name inside it, so that no optimizer rule can
    write them out again for each use."""
    t = F.coalesce(text, F.lit(""))

    def verdict(m: Column) -> Column:
        get = lambda name: m[name]
        return ~failed_base(get) & (F.size(failing(rules, get)) == 0)

    return _let(F.struct(t.alias("t"), _words(t).alias("w"), _lines(t).alias("l")), lambda x: _let(F.struct(*_counts(x["t"], x["w"], x["l"])), verdict))


def judge(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules=RULES) -> DataFrame:
    """measures() with base_failed, failed_rules (array of names) and kept."""
    m = measures(df, text, keep).withColumn("base_failed", failed_base()).withColumn("failed_rules", failing(rules))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_documents(df: DataFrame, rules=RULES) -> DataFrame:
    """The rows of df that judge() keeps, with df's columns."""
    return df.where(passes(F.col("text"), rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rules() -> str:
    out = []
    for _, top, bottom, least, most in RULES:
        by = "1.0::DOUBLE" if bottom is None else f"{bottom}::DOUBLE"
        some = "TRUE" if bottom is None else f"{bottom} > 0"
        tests = [f"{top} {sign} {float(x)}::DOUBLE * {by}" for sign, x in (("<", least), (">", most)) if x is not None]
        out.append(f"({some} AND ({' OR '.join(tests)}))")
    return " OR ".join(out)


_STOP = ", ".join(f"'{w}'" for w in _WRITTEN)
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
one AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM w WHERE len(w) > 8),
win AS (SELECT r, i, n, concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 8))}) AS x FROM one WINDOW o AS (PARTITION BY r ORDER BY i)),
hit AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win WHERE i <= n - 7),
pos AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM hit WHERE n > 1),
rep AS (SELECT r, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n FROM pos GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]')))::BIGINT AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_sql_rules()}) AS kept FROM b
"""
