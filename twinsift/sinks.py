"""Side effects, kept apart from the plans that decide them.

Each takes a DataFrame of decisions and works it off in its partitions; with dry_run nothing is touched. Moves and links are
safe to repeat: a task that runs again finds the work done.
"""

from __future__ import annotations

import filecmp
import os
import shutil
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("copy", "hardlink", "reflink", "symlink")


def move(plan: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Moves rel_path below root to target (below root where it isn't absolute); rel_path, target, status and _error."""
    root = os.path.abspath(root)

    def run(frames):
        for f in frames:
            status, errors = [], []
            for rel, target in zip(f.rel_path, f.target, strict=True):
                a, b = os.path.join(root, rel), os.path.join(root, target)
                error = None
                if dry_run:
                    state = "would move"
                elif not os.path.lexists(a) and os.path.lexists(b):
                    state = "moved"
                else:
                    try:
                        os.makedirs(os.path.dirname(b), exist_ok=True)
                        shutil.move(a, b)
                        state = "moved"
                    except OSError as e:
                        state, error = "failed", str(e)
                status.append(state)
                errors.append(error)
            yield f.assign(status=status, _error=errors)

    return plan.select("rel_path", "target").distinct().mapInPandas(run, "rel_path string, target string, status string, _error string")


def place(a: str, b: str, mode: str) -> str:
    """Puts file a at b; what is there already and the same stays."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    os.makedirs(os.path.dirname(b), exist_ok=True)
    if os.path.lexists(b):
        if os.path.islink(b) and os.path.realpath(b) == os.path.realpath(a) or os.path.isfile(b) and filecmp.cmp(a, b, shallow=False):
            return "kept"
        raise FileExistsError(b)
    if mode == "symlink":
        os.symlink(os.path.abspath(a), b)
    elif mode == "hardlink":
        os.link(a, b)
    else:
        if mode == "reflink":
            warnings.warn("this file system interface has no reflinks; the file is copied", stacklevel=2)
        shutil.copy2(a, b)
    return mode


def materialise(names: DataFrame, root: str, out: str, mode: str = "copy") -> DataFrame:
    """Files rel_path below root as file_name below out; rel_path, file_name, status and _error."""
    root, out = os.path.abspath(root), os.path.abspath(out)

    def run(frames):
        for f in frames:
            status, errors = [], []
            for rel, name in zip(f.rel_path, f.file_name, strict=True):
                try:
                    status.append(place(os.path.join(root, rel), os.path.join(out, name), mode))
                    errors.append(None)
                except OSError as e:
                    status.append("failed")
                    errors.append(str(e))
            yield f.assign(status=status, _error=errors)

    return names.select("rel_path", "file_name").distinct().mapInPandas(run, "rel_path string, file_name string, status string, _error string")


def write_jsonl(metadata: DataFrame, path: str, one_file: bool = True) -> None:
    """A JSON object a line, in order of file_name; one file unless the table is too large for that."""
    rows = metadata.orderBy("file_name", "text")
    (rows.coalesce(1) if one_file else rows).select(F.to_json(F.struct("file_name", "text")).alias("value")).write.mode("overwrite").text(path)
