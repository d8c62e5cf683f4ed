"""Command line: python -m twinsift.cli {dedupe,import-dedupe,store-test,encode-test,captions} ...

Without a trash folder the two dedupe commands only report; a dry run and --skip-update leave the store as it is.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift import encode, sinks
from twinsift.functions.vectors import as_double, check_dimensions
from twinsift.operators import captions, catalog, grouping, keep, reports, simjoin
from twinsift.sources import headers, listing
from twinsift.storage import cut

MODEL = "stand-in"


def _flags(p: argparse.ArgumentParser, sets: tuple[str, ...], batch: bool = True) -> None:
    for s in sets:
        short = s[0] if len(sets) > 1 else ""
        name = f"{s}-" if len(sets) > 1 else ""
        p.add_argument(f"-{short}i", f"--{name}image-dir", required=True, dest=f"{s}_images")
        p.add_argument(f"-{short}d", f"--{name}db-dir", required=True, dest=f"{s}_store")
    p.add_argument("--clean-orphans", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("-f", "--force-update", action="store_true")
    p.add_argument("-c", "--device", default="cpu", help="for encoders that use one")
    if batch:
        p.add_argument("-b", "--batch-size", type=int, default=4)
    p.add_argument("-m", "--model-id", default=MODEL)
    p.add_argument("--skip-update", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinsift")
    sub = top.add_subparsers(dest="command", required=True)
    for name, sets in (("dedupe", ("base",)), ("import-dedupe", ("base", "import"))):
        p = sub.add_parser(name)
        _flags(p, sets, batch=name == "dedupe")
        p.add_argument("-t", "--trash-dir")
        p.add_argument("-n", "--dry-run", action="store_true")
        p.add_argument("-th", "--threshold", type=float, default=0.1)
        if name == "dedupe":
            p.add_argument("-kl", "--keeping-logic", type=str.lower, choices=sorted(keep.POLICIES), default="largest")
    _flags(sub.add_parser("store-test"), ("base",))
    p = sub.add_parser("encode-test")
    p.add_argument("-m", "--model-id", default=MODEL)
    p.add_argument("-d", "--device", default="cpu")
    p.add_argument("-p", "--dtype", type=str.lower, choices=sorted(encode.DTYPES), default="fp32")
    p.add_argument("paths", nargs="*")
    p = sub.add_parser("captions")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--clip-model", choices=sorted(captions.COUNTERS), default=MODEL, help="whose tokens the parts are counted in")
    p.add_argument("--mode", choices=sinks.MODES, default="copy")
    return top


def _store(spark: SparkSession, a: argparse.Namespace, which: str) -> tuple[DataFrame, DataFrame]:
    """The manifest, and idx, rel_path and v of the store's rows whose file is there."""
    root, path = getattr(a, f"{which}_images"), getattr(a, f"{which}_store")
    manifest = listing.manifest(spark, root)
    if not (a.skip_update or getattr(a, "dry_run", False)):
        counts = encode.update_store(spark, manifest, root, path, a.model_id, a.force_update, a.clean_orphans, getattr(a, "batch_size", 4), a.device)
        print(", ".join(f"{k} {v}" for k, v in counts.items()))
    held = catalog.require(catalog.without_orphans(manifest, encode.read_store(spark, path, a.model_id)))
    check_dimensions(held, "embedding")
    shape = reports.store_shape(held).first()
    print(f"{shape.n} x {shape.dim}, {reports.readable(shape.bytes)}")
    return manifest, simjoin.with_idx(held.select("rel_path", "embedding"), "rel_path", as_double(F.col("embedding")))


def _told(pairs: DataFrame, left: DataFrame, right: DataFrame) -> None:
    """A line for each match, in order; rows come one partition at a time, and a row with many matches isn't gathered."""
    named = pairs.join(left.select(F.col("idx").alias("i"), F.col("rel_path").alias("path")), "i").join(right.select(F.col("idx").alias("j"), F.col("rel_path").alias("other")), "j")
    counted = named.join(pairs.groupBy("i").agg(F.count("*").alias("n")), "i")
    last = None
    for r in counted.orderBy("i", "j").toLocalIterator():
        if r.i != last:
            print(f"Found {r.n} duplicates for {r.path}:")
            last = r.i
        print(f"  {r.other} {r.dist:.6f}")


def _moved(plan: DataFrame, root: str, dry_run: bool) -> None:
    for r in sinks.move(plan, root, dry_run).toLocalIterator():
        print(f"{r.status}: {r.rel_path} -> {r.target}" + (f" ({r._error})" if r._error else ""))


def dedupe(spark: SparkSession, a: argparse.Namespace) -> int:
    manifest, rows = _store(spark, a, "base")
    # written, because files are about to move
    rows = cut(rows)
    pairs = cut(simjoin.self_join(rows, a.threshold))
    grouped = cut(grouping.groups(pairs))
    _told(pairs.join(grouped.where("pos = 0").select(F.col("leader").alias("i")), "i", "left_semi"), rows, rows)
    if a.trash_dir:
        named = rows.join(grouping.marked(grouped), "idx", "left_semi").select("rel_path")
        described = headers.headers(listing.contents(named, a.base_images)).drop("_error")
        files = rows.select("idx", "rel_path").join(manifest, "rel_path").join(described, "rel_path", "left").withColumnRenamed("mtime_ns", "mtime")
        plan = cut(keep.live_decisions(grouped, files, a.keeping_logic, os.path.abspath(a.trash_dir)))
        _moved(plan, a.base_images, a.dry_run)
    s = reports.dedupe_summary(rows, grouped).first()
    print(f"Processed {s.processed} images, {s.duplicates} duplicates." + " (dry run)" * a.dry_run)
    return 0


def import_dedupe(spark: SparkSession, a: argparse.Namespace) -> int:
    _, base = _store(spark, a, "base")
    _, incoming = _store(spark, a, "import")
    base, incoming = cut(base), cut(incoming)
    pairs = cut(simjoin.cross_set_join(incoming, base, a.threshold))
    _told(pairs, incoming, base)
    if a.trash_dir:
        trash = os.path.abspath(a.trash_dir)
        plan = simjoin.duplicates(incoming, pairs).select("rel_path", F.concat(F.lit(f"{trash}/"), "rel_path").alias("target"))
        _moved(plan, a.import_images, a.dry_run)
    s = reports.import_summary(incoming, pairs).first()
    print(f"Processed {s.processed} images, {s.n_images} duplicates in {s.n_pairs} pairs." + " (dry run)" * a.dry_run)
    return 0


def store_test(spark: SparkSession, a: argparse.Namespace) -> int:
    began = time.time()
    _, rows = _store(spark, a, "base")
    print(f"{rows.count()} rows in {time.time() - began:.1f} s")
    return 0


def encode_test(spark: SparkSession, a: argparse.Namespace) -> int:
    done = cut(encode.encode(listing.listed(spark, a.paths), a.model_id, device=a.device, dtype=a.dtype))
    for r in done.where("_error IS NOT NULL").toLocalIterator():
        print(f"{r.rel_path}: {r['_error']}")
    rows = simjoin.with_idx(done.where("_error IS NULL").select("rel_path", "embedding"), "rel_path", as_double(F.col("embedding")))
    names = rows.select(F.col("idx").alias("i"), F.col("rel_path").alias("a")), rows.select(F.col("idx").alias("j"), F.col("rel_path").alias("b"))
    for r in simjoin.pairwise_matrix(rows, rows).join(names[0], "i").join(names[1], "j").orderBy("i", "j").toLocalIterator():
        print(f"{r.a}\t{r.b}\t{r.dist:.6f}")
    return 0


def prepare_captions(spark: SparkSession, a: argparse.Namespace) -> int:
    files = listing.manifest(spark, a.input)
    notes = listing.contents(files.where(F.col("rel_path").endswith(".txt")).select("rel_path"), a.input)
    texts = notes.select("rel_path", F.decode("content", "UTF-8").alias("content"))
    paired = captions.require_distinct_names(cut(captions.pairs(files, texts)))
    meta = cut(captions.metadata(paired, captions.COUNTERS[a.clip_model]))
    sinks.write_jsonl(meta, f"{a.output}/metadata.jsonl")
    names = paired.select("rel_path", F.translate("rel_path", "/", "_").alias("file_name"))
    bad = cut(sinks.materialise(names, a.input, f"{a.output}/images", a.mode).where("_error IS NOT NULL"))
    for r in bad.toLocalIterator():
        print(f"{r.rel_path}: {r['_error']}")
    failed = bad.count()
    print(f"{meta.count()} rows, {failed} files failed")
    return int(failed > 0)


COMMANDS = {"dedupe": dedupe, "import-dedupe": import_dedupe, "store-test": store_test, "encode-test": encode_test, "captions": prepare_captions}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("twinsift").getOrCreate()
    try:
        return COMMANDS[a.command](spark, a)
    except catalog.EmptyStoreError as e:
        print(e)
        return 1


def _command(name: str):
    """An installed program for one command."""

    def run() -> int:
        return main([name, *sys.argv[1:]])

    return run


dedupe_main, import_main, store_main, encode_main, captions_main = map(_command, COMMANDS)


if __name__ == "__main__":
    sys.exit(main())
