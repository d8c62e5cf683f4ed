"""What several operators need: tables cut from their lineage, and counted sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session names none and one machine runs all
    (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/twinsift-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: no lineage, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for the tables, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/cut-" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The bytes of a text column, counted."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def parts(n_bytes: int, mb: float, least: int = 16) -> int:
    """So many buckets that each has about mb MB of n_bytes; a count that follows the input and nothing else."""
    return max(least, -(-n_bytes // int(mb * 2**20)))


def trimmed(c):
    return F.btrim(c, F.lit(WHITE))


#: Tasks that the rows of one key are dealt over in salted().
SALTS = 16


def salted(rows: DataFrame, table: DataFrame, key: str | list[str], spread) -> DataFrame:
    """rows left-joined with table, which has each key (one column or several) once. Rows of a hot key, or of none, are dealt over SALTS tasks by a hash
    of `spread`, a column; table is copied as often."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*([key] if isinstance(key, str) else key), "_salt"], "left").drop("_salt")
