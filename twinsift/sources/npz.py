"""Import of NumPy archives, one for each file, with one array each."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.paths import strip_suffix

#: Fixed value: the name of the array in an archive.
KEY = "clip_embedding"


def load(files: DataFrame, key: str = KEY) -> DataFrame:
    """rel_path (without .npz), embedding and _error of the .npz files among files (rel_path, content)."""

    def run(frames):
        for f in frames:
            out = []
            for path, content in zip(f.rel_path, f.content, strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        out.append((path, z[key].astype(np.float32).reshape(-1), None))
                except Exception as e:  # noqa: BLE001  whatever a broken archive raises is its row's error
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["rel_path", "embedding", "_error"])

    some = files.where(F.col("rel_path").endswith(".npz")).select("rel_path", "content")
    read = some.mapInPandas(run, "rel_path string, embedding array<float>, _error string")
    return read.select(strip_suffix(F.col("rel_path")).alias("rel_path"), "embedding", "_error")


def loaded(files: DataFrame, key: str = KEY) -> DataFrame:
    return load(files, key).where("_error IS NULL").drop("_error")


def dump(vector) -> bytes:
    """A compressed archive with one array."""
    out = io.BytesIO()
    np.savez_compressed(out, **{KEY: np.asarray(vector, np.float32)})
    return out.getvalue()
