"""Encoders and the upkeep of the embedding store.

An encoder turns contents into vectors. It is built once in each Python worker, by name and options, and closed when the
worker's task ends. A real image model can't be installed here; StandIn is a deterministic stand-in for tests: equal pixels
give equal vectors, and that is all that it promises.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators import catalog
from twinsift.sources import headers, listing
from twinsift.storage import cut

STORE = "rel_path string, model_id string, embedding array<float>, encoded_at_ns long, src_mtime_ns long"
#: Spellings of the number formats that an encoder may run in.
DTYPES = {"float32": "fp32", "fp32": "fp32", "float16": "fp16", "fp16": "fp16"}
_NUMPY = {"fp32": np.float32, "fp16": np.float16}


class Encoder(Protocol):
    def preprocess(self, image): ...
    def encode(self, prepared: list) -> np.ndarray: ...
    def close(self) -> None: ...


class StandIn:
    """image: what headers.pixels() gives, a decoded RGB image or, without Pillow, the file's bytes."""

    def __init__(self, dim: int = 64, device: str = "cpu", dtype: str | None = None):
        if device != "cpu":
            raise ValueError(f"the stand-in runs on the cpu, not on {device!r}")
        self.dim, self.dtype = dim, number_format(dtype, device)

    def preprocess(self, image) -> bytes:
        return image if isinstance(image, bytes) else repr(image.size).encode() + image.tobytes()

    def encode(self, prepared: list[bytes]) -> np.ndarray:
        out = np.empty((len(prepared), self.dim), np.float32)
        for k, c in enumerate(prepared):
            seed = int.from_bytes(hashlib.sha256(c).digest()[:8], "little")
            v = np.random.default_rng(seed).normal(size=self.dim)
            out[k] = v / np.linalg.norm(v)
        return out.astype(_NUMPY[self.dtype]).astype(np.float32)

    def close(self) -> None:
        pass


ENCODERS: dict[str, Callable[..., Encoder]] = {"stand-in": StandIn}


def number_format(name: str | None, device: str = "cpu") -> str:
    """The format by any of its names; without one, fp16 on a GPU and fp32 elsewhere."""
    if name is None:
        return "fp16" if device.startswith("cuda") else "fp32"
    if name.lower() not in DTYPES:
        raise ValueError(f"unknown number format {name!r}")
    return DTYPES[name.lower()]


def encode(files: DataFrame, model_id: str = "stand-in", batch: int = 4, device: str = "cpu", dtype: str | None = None, **options) -> DataFrame:
    """rel_path, embedding and _error of files (rel_path, content); contents that are no whole image have an _error."""

    def run(frames):
        encoder = ENCODERS[model_id](device=device, dtype=dtype, **options)
        try:
            for f in frames:
                for at in range(0, len(f), batch):
                    part = f.iloc[at : at + batch]
                    errors: list[str | None] = []
                    good = []
                    for c in part.content:
                        try:
                            headers.check(c)
                            good.append(encoder.preprocess(headers.pixels(c)))
                            errors.append(None)
                        except ValueError as e:
                            errors.append(str(e))
                    vectors = iter(encoder.encode(good) if good else ())
                    yield pd.DataFrame({"rel_path": part.rel_path, "embedding": [next(vectors) if e is None else None for e in errors], "_error": errors})
        finally:
            encoder.close()

    return files.select("rel_path", "content").mapInPandas(run, "rel_path string, embedding array<float>, _error string")


def _versions(spark: SparkSession, path: str):
    """The file system of path, and the numbers of its whole versions: those whose write was finished."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = [n for n in names if re.fullmatch(r"v\d+", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return fs, sorted(int(n[1:]) for n in whole)


def read_store(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    """The newest whole version of the store at path; an empty table where there is none yet. Partitioned by model_id."""
    _, versions = _versions(spark, path)
    store = spark.read.schema(STORE).parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], STORE)
    return store if model_id is None else store.where(F.col("model_id") == model_id)


def update_store(
    spark: SparkSession, files: DataFrame, root: str, path: str, model_id: str = "stand-in", force: bool = False, clean: bool = True, batch: int = 4, device: str = "cpu", dtype: str | None = None
) -> dict[str, int]:
    """Brings the store at path in step with files (rel_path, mtime_ns, size_bytes, below root): encodes what is new or
    changed, drops orphans, and writes the next version. A version counts from the moment that its write has ended, so a
    run that breaks off leaves the store as it was. The version before stays for those who read it; older ones go."""
    store = read_store(spark, path)
    manifest = cut(files.select("rel_path", "mtime_ns", "size_bytes"))
    todo = cut(catalog.candidates(manifest, store, force, model_id).select("rel_path", "mtime_ns"))
    now = time.time_ns()
    # only the candidates' contents are read
    done = encode(listing.contents(todo.select("rel_path"), root), model_id, batch, device, dtype)
    fresh = cut(done.join(todo, "rel_path").select("rel_path", F.lit(model_id).alias("model_id"), "embedding", F.lit(now).alias("encoded_at_ns"), F.col("mtime_ns").alias("src_mtime_ns"), "_error"))
    counts = {"encoded": fresh.where("_error IS NULL").count(), "failed": fresh.where("_error IS NOT NULL").count(), "orphans": catalog.orphans(manifest, store).count()}
    new = catalog.refreshed(manifest, store, fresh.where("_error IS NULL").drop("_error"), clean)
    fs, versions = _versions(spark, path)
    new.write.mode("overwrite").partitionBy("model_id").parquet(f"{path}/v{versions[-1] + 1 if versions else 0}")
    for old in versions[:-1]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}"), True)
    return counts
