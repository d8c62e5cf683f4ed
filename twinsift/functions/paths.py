"""Path expressions; all are plain Catalyst expressions with Python's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names of known image sources, best first, matched from the start of the base name.
SOURCE_PATTERNS = (
    (4, r"[0-9]+_p[0-9]+\..*"),
    (3, r"yande\.re [0-9]+ .*\..*"),
    (2, r"__.*__[0-9a-f]{32}\..*"),
    (1, r"Konachan\.com - [0-9]+ .*\..*"),
)
#: Base and extension as Python's splitext sees them: a name that only begins with dots has no extension.
SPLIT_EXT = r"^((?:.*/)?\.*[^./][^/]*?)(\.[^./]*)$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, SPLIT_EXT, 2)


def base(path: Column) -> Column:
    """The path without its extension."""
    return F.when(path.rlike(SPLIT_EXT), F.regexp_extract(path, SPLIT_EXT, 1)).otherwise(path)


def strip_suffix(path: Column, suffix: str = ".npz") -> Column:
    """Drops the suffix once, at the end."""
    return F.when(path.endswith(suffix), F.left(path, F.length(path) - len(suffix))).otherwise(path)


def flatten(path: Column) -> Column:
    return F.translate(path, "/", "_")


def source_score(path: Column) -> Column:
    name = base_name(path)
    out = None
    for score, pattern in SOURCE_PATTERNS:
        hit = name.rlike(f"(?d)^{pattern}")
        out = F.when(hit, F.lit(score)) if out is None else out.when(hit, F.lit(score))
    return out.otherwise(F.lit(0)).cast("long")


def is_wallpaper(path: Column) -> Column:
    return dir_name(path).contains("Wallpaper")


def trash_path(trash_dir: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(trash_dir.rstrip("/")), path)
