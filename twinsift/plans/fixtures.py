"""Inputs derived from the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.vectors import as_double
from twinsift.operators import simjoin
from twinsift.plans.tables import table


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), as_double(F.col("embedding")).alias("v"))


RAW = "SELECT vec_id AS idx, embedding::DOUBLE[] AS v FROM embeddings"


def _moved(rows: DataFrame, dim: int, by: float, to) -> DataFrame:
    return rows.select(to.alias("idx"), F.transform("v", lambda x, i: F.when(i == dim, x + F.lit(by)).otherwise(x)).alias("v"))


def _moved_sql(dim: int, by: float, to: str, where: str) -> str:
    return f"SELECT {to} AS idx, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = {dim + 1} THEN x + {by}::DOUBLE ELSE x END) AS v FROM embeddings WHERE {where}"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw with copies at 0.05 of every seventh vector and at 0.12 of every fourteenth."""
    r = raw(spark, sf_dir)
    i = F.col("idx")
    return r.unionAll(_moved(r.where(i % 7 == 0), 0, 0.05, i + 1000000)).unionAll(_moved(r.where(i % 14 == 0), 0, 0.12, i + 2000000))


PLANTED = f"{RAW} UNION ALL {_moved_sql(0, 0.05, 'vec_id + 1000000', 'vec_id % 7 = 0')} UNION ALL {_moved_sql(0, 0.12, 'vec_id + 2000000', 'vec_id % 14 = 0')}"


def planted_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n vectors at their ranks i, and copies at 2 i + 1 and 2 i where those are n or more, else at 2 n + i: contiguous idx."""
    r = table(spark, sf_dir, "embeddings")
    n = r.count()
    v = r.join(simjoin.ranks(r.select(F.col("vec_id").alias("id"))), F.col("vec_id") == F.col("id")).select(F.col("r").alias("idx"), as_double(F.col("embedding")).alias("v"))
    i = F.col("idx")
    meets, misses = _moved(v.where(2 * i + 1 >= n), 0, 0.05, 2 * i + 1), _moved(v.where(2 * i >= n), 1, 0.05, 2 * i)
    return v.unionAll(meets).unionAll(misses).unionAll(_moved(v.where(2 * i + 1 < n), 0, 0.05, i + 2 * n))


_RANKED = "(SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding, count(*) OVER () AS n FROM embeddings)"
PLANTED_COMPAT = f"{RAW} UNION ALL {_moved_sql(0, 0.05, '2 * vec_id + 1', '2 * vec_id + 1 >= n')} UNION ALL {_moved_sql(1, 0.05, '2 * vec_id', '2 * vec_id >= n')} UNION ALL {_moved_sql(0, 0.05, 'vec_id + 2 * n', '2 * vec_id + 1 < n')}".replace("FROM embeddings", f"FROM {_RANKED}")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, rel_path, mtime, size_bytes, width, height, format: a catalogue of image files that don't exist."""
    i = F.col("vec_id")
    folder = F.when(i % 5 == 0, "Wallpaper/").when(i % 5 == 1, "VWallpaper/x/").otherwise("Anime/")
    name = (
        F.when(i % 6 == 0, F.concat((i + 1000).cast("string"), F.lit("_p"), (i % 3).cast("string"), F.lit(".jpg")))
        .when(i % 6 == 1, F.concat(F.lit("yande.re "), i.cast("string"), F.lit(" tag.png")))
        .when(i % 6 == 2, F.concat(F.lit("__tag__"), F.md5(i.cast("string")), F.lit(".jpg")))
        .when(i % 6 == 3, F.concat(F.lit("Konachan.com - "), i.cast("string"), F.lit(" tag.png")))
        .when(i % 6 == 4, F.concat(F.lit("tw-"), i.cast("string"), F.lit(".webp")))
        .otherwise(F.concat(F.lit("misc"), i.cast("string"), F.lit(".png")))
    )
    kind = F.when((i % 6).isin(1, 3, 5), "PNG").when(i % 6 == 4, "WEBP").otherwise("JPEG")
    rows = table(spark, sf_dir, "embeddings").select("vec_id").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").alias("mtime")), "vec_id")
    return rows.select(i.alias("idx"), F.concat(folder, name).alias("rel_path"), "mtime", (1000 + (i * 37) % 50).alias("size_bytes"), (100 * (1 + i % 3)).alias("width"), (100 * (1 + i % 2)).alias("height"), kind.alias("format"))


MANIFEST = """SELECT vec_id AS idx, CASE vec_id % 5 WHEN 0 THEN 'Wallpaper/' WHEN 1 THEN 'VWallpaper/x/' ELSE 'Anime/' END ||
  CASE vec_id % 6 WHEN 0 THEN (vec_id + 1000)::VARCHAR || '_p' || (vec_id % 3)::VARCHAR || '.jpg' WHEN 1 THEN 'yande.re ' || vec_id::VARCHAR || ' tag.png'
  WHEN 2 THEN '__tag__' || md5(vec_id::VARCHAR) || '.jpg' WHEN 3 THEN 'Konachan.com - ' || vec_id::VARCHAR || ' tag.png'
  WHEN 4 THEN 'tw-' || vec_id::VARCHAR || '.webp' ELSE 'misc' || vec_id::VARCHAR || '.png' END AS rel_path,
  ts AS mtime, 1000 + (vec_id * 37) % 50 AS size_bytes, 100 * (1 + vec_id % 3) AS width, 100 * (1 + vec_id % 2) AS height,
  CASE WHEN vec_id % 6 IN (1, 3, 5) THEN 'PNG' WHEN vec_id % 6 = 4 THEN 'WEBP' ELSE 'JPEG' END AS format
  FROM embeddings JOIN events ON event_id = vec_id"""


def catalog_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest that lacks every eleventh file, and a store that lacks every thirteenth, with times a second off or equal."""
    m = manifest(spark, sf_dir).withColumn("mtime_ns", 1000 * F.unix_micros(F.col("mtime").cast("timestamp")))
    i = F.col("idx")
    files = m.where(i % 11 != 0).select("idx", "rel_path", "mtime_ns", "size_bytes")
    store = m.where(i % 13 != 0).select("rel_path", (F.col("mtime_ns") + (i % 3 - 1) * 1000000000).alias("encoded_at_ns"))
    return files, store


DELTA = f"""m AS (SELECT *, 1000 * epoch_us(mtime) AS mtime_ns FROM ({MANIFEST})),
files AS (SELECT idx, rel_path, mtime_ns, size_bytes FROM m WHERE idx % 11 <> 0),
store AS (SELECT rel_path, mtime_ns + (idx % 3 - 1) * 1000000000 AS encoded_at_ns FROM m WHERE idx % 13 <> 0)"""
