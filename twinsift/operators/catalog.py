"""A catalogue of files against the store of their embeddings.

manifest: rel_path, mtime_ns, size_bytes. store: rel_path, model_id, embedding, encoded_at_ns, src_mtime_ns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmptyStoreError(ValueError):
    """There is nothing to compare."""


def candidates(manifest: DataFrame, store: DataFrame, force: bool = False, model_id: str | None = None) -> DataFrame:
    """Rows of manifest to encode: new ones and those whose file is not older than their entry (equal times are stale)."""
    if model_id is not None:
        store = store.where(F.col("model_id") == model_id)
    known = store.select("rel_path", F.col("encoded_at_ns").alias("_at"))
    fresh = F.col("_at").isNotNull() & (F.col("mtime_ns") < F.col("_at"))
    return manifest.join(known, "rel_path", "left").where(F.lit(force) | ~fresh).drop("_at")


def orphans(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Entries whose file is gone."""
    return store.join(manifest.select("rel_path"), "rel_path", "left_anti")


def without_orphans(manifest: DataFrame, store: DataFrame) -> DataFrame:
    return store.join(manifest.select("rel_path"), "rel_path", "left_semi")


def refreshed(manifest: DataFrame, store: DataFrame, encoded: DataFrame, clean: bool = True) -> DataFrame:
    """The store with encoded rows in place of their old entries and, where asked for, without orphans."""
    # an entry gives way to a new one of its own model only
    same = [c for c in ("rel_path", "model_id") if c in store.columns]
    old = store.join(encoded.select(*same), same, "left_anti")
    if clean:
        old = without_orphans(manifest, old)
    return old.unionByName(encoded)


def stale(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Entries whose file changed after they were made."""
    return store.join(manifest.select("rel_path", "mtime_ns"), "rel_path").where("mtime_ns >= encoded_at_ns").drop("mtime_ns")


def require(store: DataFrame) -> DataFrame:
    if store.isEmpty():
        raise EmptyStoreError("the store is empty")
    return store
