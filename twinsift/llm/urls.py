"""URL filters with redirect equivalence; DataFrame functions only.

A rule (verdict, host, path start) fits the urls of its host and of all hosts below it whose path begins so; the
longest one wins. Addresses that redirect to each other or name each other as canonical are one page: connected
components over these edges carry a block to every alias that no rule of its own fits, unless a rule allows a
member of the component, which then takes precedence.

Defined results: a null url, or one without '://', has an empty host and path, fits no rule, has no aliases and is
allowed. Null html gives no edges. Repeated urls are one node, and each row gets its verdict. Fragments don't
count in an address. Links are resolved as they read on their page: against its address or its base, without . and .. segments.
Of rules of equal length that fit, which can only be equal rules, the first counts. Very long pages and urls are read whole. Extra
columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.components import components
from twinsift.llm.shared import salted

NAME = "op10_url_filter"

#: (verdict, host, start of the path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _address(url: Column) -> Column:
    """An address as a node: host, path (/ for an empty one) and query; null without '://'."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _plain(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""

    def step(done, x):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a path that ends in . or .. names a folder
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def _resolved(base: Column, link: Column) -> Column:
    """A link as a whole address, as it reads on a page at base; null where it has a scheme without '://', or none of both has one."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    link = F.btrim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    path = F.regexp_replace(path_of(base), "^$", "/")
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    whole = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.locate("://", base) == 0, F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, _plain(own), rest))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link.startswith("#") | (link == ""), F.concat(site, path, query, link))
    )
    return whole.otherwise(F.concat(site, _plain(F.concat(folder, own)), rest))


_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)^<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*\d*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def alias_edges(pages: DataFrame) -> DataFrame:
    """a, b: addresses that a canonical link or a meta refresh makes equal."""
    base = F.regexp_extract("html", _BASE, 1)
    some = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", "html")
    some = some.select("url", "html", F.when(base == "", F.col("url")).otherwise(_resolved(F.col("url"), base)).alias("base"))
    tags = some.select("url", "base", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
    links = F.array(F.regexp_extract("tag", _CANONICAL, 1), F.regexp_extract("tag", _REFRESH, 1))
    found = tags.select("url", "base", F.explode(links).alias("link")).where("link <> ''")
    return found.select(_address(F.col("url")).alias("a"), _address(_resolved(F.col("base"), F.col("link"))).alias("b")).where("a <> b").distinct()


def judge(pages: DataFrame, rules: Sequence = RULES, more_edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, address, component (null: the address has no alias).

    pages has page_id, url and html; more_edges has a and b, such as the from and to of a redirect log, as urls.
    """
    url = F.col("url")
    p = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), _address(url).alias("address"))
    edges = alias_edges(pages)
    if more_edges is not None:
        edges = edges.union(more_edges.select(_address(F.col("a")), _address(F.col("b"))))
    members = components(edges)
    node = F.concat(F.lit("x://"), F.col("node"))
    _, by_node = matched(host_of(node), path_of(node), rules)
    judged = members.withColumn("own", by_node)
    # one row for each component; hubs are met by partial aggregation
    spread = judged.groupBy("component").agg(F.max(F.col("own") == "block").alias("some_block"), F.max(F.col("own") == "allow").alias("some_allow"))
    alias = judged.join(spread, "component").select(F.col("node").alias("address"), "component", (F.coalesce("some_block", F.lit(False)) & ~F.coalesce("some_allow", F.lit(False))).alias("spread_block"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    out = salted(p.withColumn("rule", rule).withColumn("own", verdict), alias, "address", F.monotonically_increasing_id())
    spread_to = F.when(F.coalesce("spread_block", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", spread_to).alias("verdict"), "address", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _planted(pages: DataFrame) -> DataFrame:
    """pages with planted links: most name the page of the next id (in threes) as canonical, as a redirect, by its path or
    relative to their own folder."""
    next_ = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to"))
    k = F.col("page_id") % 12
    site, path = F.regexp_extract("url", r"^(.*?://[^/?#]*)", 1), path_of(F.col("url"))
    tag = (
        F.when(k == 0, F.concat(F.lit('<link rel="canonical" href="'), "to", F.lit('">')))
        .when(k == 1, F.concat(F.lit("<META http-equiv='Refresh' content='0; url="), "to", F.lit("'>")))
        .when(k == 3, F.concat(F.lit("<link href="), path, F.lit("/../up rel=canonical>")))
        .when(k == 4, F.lit('<link rel=canonical href="same-folder">'))
        .when(k == 6, F.lit("<link rel='canonical' href='?page=2'>"))
        .when(k == 7, F.concat(F.lit('<link rel="canonical" href="http://sub.example.com'), path, F.lit('">')))
        .otherwise("")
    )
    joined = pages.select("page_id", "url", "html").join(next_, "page_id", "left")
    return joined.select("page_id", "url", F.concat(F.coalesce(tag, F.lit("")), F.coalesce("html", F.lit(""))).alias("html"))


def planted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() where the table's pages have aliases."""
    got = judge(_planted(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return got.select("page_id", "host", "path", "rule", "verdict", "component")


def _fits(h: str, p: str, host: str, path: str) -> str:
    return f"(({host} = '{h}' OR suffix({host}, '.{h}')) AND starts_with({path}, '{p}'))"


def _case(of: str, host: str, path: str) -> str:
    rows = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN {_fits(h, p, host, path)} THEN '{h + p if of == 'rule' else kind}'" for kind, h, p in rows) + " ELSE NULL END"


_H = r"lower(regexp_extract(coalesce({0}, ''), '^[^\x00]*?://([^/?#]*)', 1))"
_P = r"regexp_extract(coalesce({0}, ''), '^[^\x00]*?://[^/?#]*([^?#]*)', 1)"
_A = r"CASE WHEN contains({0}, '://') THEN " + _H + r" || regexp_replace(regexp_extract({0}, '^[^\x00]*?://[^/?#]*([^#]*)', 1), '^([^/]|$)', '/\1') END"
SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_H.format("url")} AS host, {_P.format("url")} AS path, {_A.format("url")} AS address FROM pages),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
link AS (SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM tag
  WHERE regexp_matches(tag, '(?is)^<link\b') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b')
  UNION ALL SELECT url, regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*\d*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1) FROM tag
  WHERE regexp_matches(tag, '(?is)^<meta\b') AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')),
parts AS (SELECT url, link, regexp_extract(url, '^(.*?:)//', 1) AS scheme, regexp_extract(url, '^(.*?://[^/?#]*)', 1) AS site,
  CASE WHEN path = '' THEN '/' ELSE path END AS path FROM (SELECT *, {_P.format("url")} AS path FROM link WHERE link <> '')),
joined AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(link, '//') THEN scheme || link WHEN starts_with(link, '/') THEN site || link
  WHEN starts_with(link, '?') THEN site || path || link ELSE site || regexp_extract(path, '^(.*/)', 1) || link END AS link FROM parts),
plain(url, link) AS (SELECT url, link FROM joined UNION SELECT url, regexp_replace(link, '/[^/?#]*/\.\./', '/') FROM plain WHERE regexp_matches(link, '^[^?#]*?://[^/]*/.*/\.\./')),
whole AS (SELECT url, link FROM plain WHERE NOT regexp_matches(link, '^[^?#]*?://[^/]*/.*/\.\./')),
e0 AS (SELECT DISTINCT {_A.format("url")} AS a, {_A.format("link")} AS b FROM whole),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
own AS (SELECT a, {_case("verdict", "regexp_extract(b, '^[^/?#]*')", "regexp_extract(b, '^[^/?#]*([^?#]*)', 1)")} AS v FROM (SELECT a, b FROM reach UNION SELECT a, a FROM e)),
comp AS (SELECT a AS address, least(a, min(b)) AS component FROM reach GROUP BY a),
spread AS (SELECT a AS address, coalesce(bool_or(v = 'block'), FALSE) AND NOT coalesce(bool_or(v = 'allow'), FALSE) AS b FROM own GROUP BY a)
SELECT page_id, host, path, {_case("rule", "host", "path")} AS rule,
  coalesce({_case("verdict", "host", "path")}, CASE WHEN spread.b THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN spread USING (address)
"""

_PLANTED = f"""planted AS (SELECT p.page_id, p.url, CASE p.page_id % 12
  WHEN 0 THEN '<link rel="canonical" href="' || n.url || '">' WHEN 1 THEN '<META http-equiv=''Refresh'' content=''0; url=' || n.url || '''>'
  WHEN 3 THEN '<link href=' || {_P.format("p.url")} || '/../up rel=canonical>' WHEN 4 THEN '<link rel=canonical href="same-folder">'
  WHEN 6 THEN '<link rel=''canonical'' href=''?page=2''>' WHEN 7 THEN '<link rel="canonical" href="http://sub.example.com' || {_P.format("p.url")} || '">' ELSE '' END AS tag, p.html
  FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1),
mine AS (SELECT page_id, url, coalesce(tag, '') || coalesce(html, '') AS html FROM planted), p AS (SELECT"""
PLANTED_SQL = (
    SQL.replace("WITH RECURSIVE p AS (SELECT", f"WITH RECURSIVE {_PLANTED}").replace("AS address FROM pages)", "AS address FROM mine)")
    .replace("SELECT page_id, host, path, CASE", "SELECT page_id, host, path, comp.component, CASE").replace("USING (address)\n", "USING (address) LEFT JOIN comp USING (address)\n")
)
