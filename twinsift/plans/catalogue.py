"""Queries by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions import paths
from twinsift.functions.vectors import as_double
from twinsift.operators import captions, catalog, grouping, keep, reports, simjoin
from twinsift.plans import fixtures as fx
from twinsift.plans.tables import table

RAW_THRESHOLD = 1.1
GROUP_THRESHOLD = 1.2

_Q: dict = {}
_S: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", F.round("dist", 6).alias("dist"))


def _pairs_sql(rows: str, threshold: float, more: str = "") -> str:
    return f"v AS MATERIALIZED ({rows}), pairs AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, list_distance(a.v, b.v) AS dist FROM v a JOIN v b ON a.idx < b.idx WHERE list_distance(a.v, b.v) <= {threshold}::DOUBLE{more})"


_OUT = "SELECT i, j, round(dist, 6) AS dist FROM pairs"


@_query("SELECT vec_id, len(embedding)::BIGINT AS dim, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def scan_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@_query("SELECT count(*) AS n, max(len(embedding))::BIGINT AS dim, count(DISTINCT len(embedding)) AS n_dims, (4 * count(*) * max(len(embedding)))::BIGINT AS bytes FROM embeddings")
def store_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.store_shape(table(spark, sf_dir, "embeddings"))


@_query(f"WITH {_pairs_sql(fx.RAW, RAW_THRESHOLD)} {_OUT}")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(simjoin.self_join(fx.raw(spark, sf_dir), RAW_THRESHOLD))


@_query(f"WITH {_pairs_sql(fx.PLANTED, 0.1)} {_OUT}")
def near_dup_pairs_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(simjoin.self_join(fx.planted(spark, sf_dir), 0.1))


@_query(_S["near_dup_pairs_planted"])
def near_dup_pairs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(simjoin.self_join(fx.planted(spark, sf_dir), 0.1, "grid"))


@_query(f"WITH {_pairs_sql(fx.PLANTED_COMPAT, 0.1)} {_OUT}")
def near_dup_pairs_intended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(simjoin.self_join(fx.planted_compat(spark, sf_dir), 0.1))


@_query(f"WITH {_pairs_sql(fx.PLANTED_COMPAT, 0.1, ' AND b.idx <> 2 * a.idx + 1')} {_OUT}")
def near_dup_pairs_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(simjoin.self_join(fx.planted_compat(spark, sf_dir), 0.1, compat_index_bug=True))


@_query(f"WITH v AS ({fx.RAW}) SELECT a.idx AS i, b.idx AS j, round(list_distance(a.v, b.v), 6) AS dist FROM v a CROSS JOIN v b")
def pairwise_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the whole table."""
    r = fx.raw(spark, sf_dir)
    return simjoin.pairwise_matrix(r, r, decimals=6)


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = fx.raw(spark, sf_dir)
    incoming, base = r.where("idx % 2 = 1"), r.where("idx % 2 = 0")
    return incoming, base, simjoin.cross_set_join(incoming, base, RAW_THRESHOLD)


_SETS = f"v AS MATERIALIZED ({fx.RAW}), m AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, list_distance(a.v, b.v) AS dist FROM v a JOIN v b ON a.idx % 2 = 1 AND b.idx % 2 = 0 WHERE list_distance(a.v, b.v) <= {RAW_THRESHOLD}::DOUBLE)"


@_query(f"WITH {_SETS} SELECT i, j, round(dist, 6) AS dist FROM m")
def import_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_sets(spark, sf_dir)[2])


@_query(f"WITH {_SETS} SELECT idx FROM v WHERE idx % 2 = 1 AND idx IN (SELECT i FROM m)")
def import_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, _, m = _sets(spark, sf_dir)
    return simjoin.duplicates(incoming.select("idx"), m)


@_query(f"WITH {_SETS} SELECT idx FROM v WHERE idx % 2 = 1 AND idx NOT IN (SELECT i FROM m)")
def import_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, _, m = _sets(spark, sf_dir)
    return simjoin.survivors(incoming.select("idx"), m)


@_query(f"WITH {_SETS} SELECT rel_path, 'trash/' || rel_path AS target FROM v JOIN ({fx.MANIFEST}) man USING (idx) WHERE idx % 2 = 1 AND idx IN (SELECT i FROM m)")
def move_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an import's duplicates go."""
    incoming, _, m = _sets(spark, sf_dir)
    files = fx.manifest(spark, sf_dir).select("idx", "rel_path")
    return simjoin.duplicates(incoming.select("idx"), m).join(files, "idx").select("rel_path", paths.trash_path("trash", F.col("rel_path")).alias("target"))


@_query(f"SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS idx FROM ({fx.MANIFEST})")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that each path of a store gets."""
    return simjoin.with_idx(fx.manifest(spark, sf_dir), "rel_path", F.lit(0)).select("rel_path", "idx")


@_query(f"WITH {_SETS} SELECT (SELECT count(*) FROM v WHERE idx % 2 = 1) AS processed, count(*) AS n_pairs, count(DISTINCT i) AS n_images FROM m")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, _, m = _sets(spark, sf_dir)
    return reports.import_summary(incoming, m)


@_query(f"WITH {_pairs_sql(fx.RAW, RAW_THRESHOLD)} SELECT i, count(*) AS n, string_agg(j::VARCHAR || ':' || format('{{:.4f}}', dist), ',' ORDER BY j) AS matches FROM pairs GROUP BY i")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.match_report(simjoin.self_join(fx.raw(spark, sf_dir), RAW_THRESHOLD))


@_query(f"WITH {_pairs_sql(fx.RAW, RAW_THRESHOLD)} SELECT i, count(*) AS n FROM pairs GROUP BY i")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.match_counts(simjoin.self_join(fx.raw(spark, sf_dir), RAW_THRESHOLD))


def _led_sql(rows: str, threshold: float, more: str = "") -> str:
    return f"""{_pairs_sql(rows, threshold, more)}, ids AS (SELECT idx, row_number() OVER (ORDER BY idx) AS rn FROM v),
before AS (SELECT j, list(i) AS earlier FROM pairs GROUP BY j),
walk(rn, led) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.rn + 1, CASE WHEN b.earlier IS NOT NULL AND list_has_any(w.led, b.earlier) THEN w.led ELSE list_append(w.led, ids.idx) END
  FROM walk w JOIN ids ON ids.rn = w.rn + 1 LEFT JOIN before b ON b.j = ids.idx),
led AS (SELECT unnest(led) AS leader FROM (SELECT led FROM walk ORDER BY rn DESC LIMIT 1)),
groups AS MATERIALIZED (SELECT leader, row_number() OVER (PARTITION BY leader ORDER BY j) AS pos, j AS member FROM led JOIN pairs ON i = leader
  UNION ALL SELECT leader, 0, leader FROM led WHERE leader IN (SELECT i FROM pairs))"""


_GROUPS = _led_sql(fx.RAW, GROUP_THRESHOLD)


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.groups(simjoin.self_join(fx.raw(spark, sf_dir), GROUP_THRESHOLD))


@_query(f"WITH RECURSIVE {_GROUPS} SELECT leader FROM groups WHERE pos = 0")
def dup_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).where("pos = 0").select("leader")


@_query(f"WITH RECURSIVE {_GROUPS} SELECT leader, pos, member FROM groups")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir)


@_query(f"WITH RECURSIVE {_led_sql(fx.PLANTED, 0.1)} SELECT leader, pos, member FROM groups")
def dup_groups_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.groups(simjoin.self_join(fx.planted(spark, sf_dir), 0.1))


@_query(f"WITH RECURSIVE {_led_sql(fx.PLANTED_COMPAT, 0.1, ' AND b.idx <> 2 * a.idx + 1')} SELECT leader, pos, member FROM groups")
def dup_groups_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.groups(simjoin.self_join(fx.planted_compat(spark, sf_dir), 0.1, compat_index_bug=True))


@_query(f"WITH RECURSIVE {_GROUPS} SELECT DISTINCT member AS idx FROM groups")
def dup_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.marked(_grouped(spark, sf_dir))


@_query(f"WITH RECURSIVE {_GROUPS} SELECT (SELECT count(*) FROM v) AS processed, count(DISTINCT member) AS duplicates, count(DISTINCT leader) AS groups FROM groups")
def dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dedupe_summary(fx.raw(spark, sf_dir), _grouped(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.manifest(spark, sf_dir).withColumn("mtime", F.date_trunc("day", "mtime"))


_WALL = r"contains(regexp_replace(rel_path, '/?[^/]*$', ''), 'Wallpaper')"
_SCORE = "CASE " + " ".join(f"WHEN regexp_matches(regexp_extract(rel_path, '[^/]*$'), '^{p}') THEN {s}" for s, p in paths.SOURCE_PATTERNS) + " ELSE 0 END"


def _keep_sql(order: str) -> str:
    return f"""{_GROUPS}, man AS (SELECT * REPLACE (date_trunc('day', mtime) AS mtime) FROM ({fx.MANIFEST})),
ranked AS (SELECT leader, member, rel_path, row_number() OVER (PARTITION BY leader ORDER BY {order}) AS r FROM groups JOIN man ON member = man.idx),
kept AS (SELECT leader, member AS keep, rel_path AS keep_path FROM ranked WHERE r = 1)"""


_ORDERS = {
    "newest": "mtime DESC, pos",
    "largest": "size_bytes DESC, pos",
    "highest-quality": "width * height DESC, (format = 'PNG') DESC, mtime DESC, rel_path DESC",
    "pic-dir": f"{_WALL} DESC, {_SCORE} DESC, pos",
}


@_query(f"WITH RECURSIVE {_keep_sql(_ORDERS['newest'])} SELECT leader, keep, keep_path FROM kept")
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.keepers(_grouped(spark, sf_dir), _files(spark, sf_dir), "newest")


@_query(f"WITH RECURSIVE {_keep_sql(_ORDERS['largest'])} SELECT leader, keep, keep_path FROM kept")
def keep_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.keepers(_grouped(spark, sf_dir), _files(spark, sf_dir), "largest")


@_query(f"WITH RECURSIVE {_keep_sql(_ORDERS['highest-quality'])} SELECT leader, keep, keep_path FROM kept")
def keep_highest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.keepers(_grouped(spark, sf_dir), _files(spark, sf_dir), "highest-quality")


@_query(f"WITH RECURSIVE {_keep_sql(_ORDERS['pic-dir'])} SELECT leader, keep, keep_path FROM kept")
def keep_pic_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.keepers(_grouped(spark, sf_dir), _files(spark, sf_dir), "pic-dir")


@_query(f"WITH RECURSIVE {_keep_sql(_ORDERS['largest'])} SELECT leader, rel_path, keep_path, 'trash/' || rel_path AS target FROM ranked JOIN kept USING (leader) WHERE member <> keep")
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.decisions(_grouped(spark, sf_dir), _files(spark, sf_dir), "largest", "trash")


_ALIVE = "list_filter(ms, lambda x: NOT list_contains(w.gone, x))"


@_query(f"""WITH RECURSIVE {_led_sql(fx.RAW, RAW_THRESHOLD)}, man AS MATERIALIZED ({fx.MANIFEST}),
g AS MATERIALIZED (SELECT leader, list(member ORDER BY {_ORDERS['largest']}) AS ms, row_number() OVER (ORDER BY leader) AS rn FROM groups JOIN man ON member = man.idx GROUP BY leader),
live(rn, leader, alive, gone) AS (SELECT 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL SELECT g.rn, g.leader, {_ALIVE}, list_concat(w.gone, ({_ALIVE})[2:]) FROM live w JOIN g ON g.rn = w.rn + 1),
gone AS (SELECT leader, alive[1] AS keep, unnest(alive[2:]) AS member FROM live)
SELECT leader, m.rel_path, k.rel_path AS keep_path, 'trash/' || m.rel_path AS target FROM gone JOIN man m ON member = m.idx JOIN man k ON keep = k.idx""")
def move_plan_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = grouping.groups(simjoin.self_join(fx.raw(spark, sf_dir), RAW_THRESHOLD))
    return keep.live_decisions(grouped, _files(spark, sf_dir), "largest", "trash")


@_query(f"SELECT rel_path, ({_SCORE})::BIGINT AS score FROM ({fx.MANIFEST})")
def source_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.manifest(spark, sf_dir).select("rel_path", paths.source_score(F.col("rel_path")).alias("score"))


@_query(f"SELECT rel_path, {_WALL} AS wallpaper FROM ({fx.MANIFEST})")
def wallpaper_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.manifest(spark, sf_dir).select("rel_path", paths.is_wallpaper(F.col("rel_path")).alias("wallpaper"))


@_query(f"WITH {fx.DELTA} SELECT idx, files.rel_path, mtime_ns, size_bytes FROM files LEFT JOIN store USING (rel_path) WHERE encoded_at_ns IS NULL OR mtime_ns >= encoded_at_ns")
def update_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.candidates(*fx.catalog_delta(spark, sf_dir)).select("idx", "rel_path", "mtime_ns", "size_bytes")


@_query(f"WITH {fx.DELTA} SELECT idx, rel_path, mtime_ns, size_bytes FROM files")
def update_candidates_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.candidates(*fx.catalog_delta(spark, sf_dir), force=True).select("idx", "rel_path", "mtime_ns", "size_bytes")


@_query(f"WITH {fx.DELTA} SELECT rel_path, encoded_at_ns FROM store WHERE rel_path NOT IN (SELECT rel_path FROM files)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.orphans(*fx.catalog_delta(spark, sf_dir))


@_query(f"WITH {fx.DELTA} SELECT store.rel_path, encoded_at_ns FROM store JOIN files USING (rel_path) WHERE mtime_ns >= encoded_at_ns")
def stale_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stale(*fx.catalog_delta(spark, sf_dir)).select("rel_path", "encoded_at_ns")


@_query(f"SELECT rel_path, rel_path || '.npz' AS entry, regexp_replace(rel_path || '.npz', '\\.npz$', '') AS back, 'trash/' || rel_path AS trash FROM ({fx.MANIFEST})")
def path_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.manifest(spark, sf_dir).select("rel_path", F.concat("rel_path", F.lit(".npz")).alias("entry"))
    return m.select("rel_path", "entry", paths.strip_suffix(F.col("entry")).alias("back"), paths.trash_path("trash", F.col("rel_path")).alias("trash"))


@_query(r"SELECT page_id, regexp_extract(url, '^((?:.*/)?\.*[^./][^/]*?)(\.[^./]*)$', 2) AS ext FROM pages")
def split_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.extension(F.col("url")).alias("ext"))


@_query("SELECT page_id, replace(url, '/', '_') AS flat FROM pages")
def flatten_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.flatten(F.col("url")).alias("flat"))


@_query("SELECT replace(p, '/', '_') AS file_name, count(DISTINCT p) AS n FROM (SELECT url AS p FROM pages UNION ALL SELECT replace(url, '://', ':_/') FROM pages WHERE page_id % 3 = 0) GROUP BY 1 HAVING count(DISTINCT p) > 1")
def flatten_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and, as planted collisions, some with a slash written as an underscore."""
    p = table(spark, sf_dir, "pages")
    planted = p.where("page_id % 3 = 0").select(F.replace("url", F.lit("://"), F.lit(":_/")).alias("rel_path"))
    return captions.collisions(p.select(F.col("url").alias("rel_path")).unionAll(planted))


def _captioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    stem = F.concat(F.lit("dir/"), F.col("doc_id").cast("string"))
    images = d.select(F.explode(F.array(F.concat(stem, F.lit(".jpg")), F.concat(stem, F.lit(".PNG")))).alias("rel_path"))
    texts = d.where("doc_id % 3 <> 0").select(F.concat(stem, F.lit(".txt")).alias("rel_path"), F.concat(F.lit(" \n"), "text", F.lit("\t\n")).alias("content"))
    return images.unionAll(texts.select("rel_path")), texts


@_query(r"SELECT 'dir/' || doc_id || e.ext AS rel_path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS caption FROM documents, (VALUES ('.jpg'), ('.PNG')) e(ext) WHERE doc_id % 3 <> 0")
def caption_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.pairs(*_captioned(spark, sf_dir))


def _count_sql(t: str) -> str:
    return rf"(len(regexp_extract_all({t}, '[A-Za-z0-9]+|[^A-Za-z0-9 \n\t]')) + 2)"


@_query(f"SELECT doc_id, {_count_sql('text')}::BIGINT AS n_tokens, {_count_sql('text')} <= 75 AS fits FROM documents")
def caption_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = captions.count_tokens(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_tokens"), (n <= captions.BUDGET).alias("fits"))


_CHUNKS = f"""d AS (SELECT doc_id, text, {_count_sql("text")} AS n FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split(text, ', ') AS ws FROM d WHERE n > 75)),
c AS MATERIALIZED (SELECT doc_id, i, w, {_count_sql("w")} AS l FROM w),
walk AS (SELECT doc_id, i, w, CASE WHEN l + 1 <= 75 THEN 0 ELSE 1 END AS part, CASE WHEN l + 1 <= 75 THEN l + 1 ELSE l END AS len FROM c WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, c.w, CASE WHEN walk.len + l + 1 <= 75 THEN part ELSE part + 1 END, CASE WHEN walk.len + l + 1 <= 75 THEN walk.len + l + 1 ELSE l END FROM walk JOIN c ON c.doc_id = walk.doc_id AND c.i = walk.i + 1),
chunks AS (SELECT doc_id, part AS pos, string_agg(w, ', ' ORDER BY i) AS text FROM walk GROUP BY doc_id, part
  UNION ALL SELECT doc_id, 0, '' FROM walk WHERE i = 1 AND part = 1 UNION ALL SELECT doc_id, 0, text FROM d WHERE n <= 75)"""


_CAPTIONS = r"(SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE doc_id % 3 <> 0)"


@_query(f"WITH RECURSIVE {_CHUNKS.replace('FROM documents', f'FROM {_CAPTIONS}')} SELECT 'dir_' || doc_id || e.ext AS file_name, text FROM chunks, (VALUES ('.jpg'), ('.PNG')) e(ext)")
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.metadata(captions.pairs(*_captioned(spark, sf_dir)))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, pos::INTEGER AS pos, text FROM chunks")
def caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@_query(f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_captions, count(*) FILTER (text = '') AS n_empty FROM chunks")
def caption_chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    return c.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_captions"), F.count(F.when(F.col("text") == "", 1)).alias("n_empty"))
