"""Listing, headers, archives, the store, moves, links and the command line on real files."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import cli, encode, sinks
from twinsift.operators import catalog
from twinsift.sources import headers, listing, npz


def png(w, h, fill=0):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([fill]) * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01"


def write(root, files):
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)


NAMES = ["_skip.bin", ".hid.bin", "a b#%.bin", f"__x__{'0' * 32}.png", "sub/_deep/x.txt", "ü.png"]


def test_listing(spark, tmp_path):
    write(tmp_path, {n: b"x" * i for i, n in enumerate(NAMES)})
    os.utime(tmp_path / "_skip.bin", ns=(1, 1234567890123456789))
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    got = {r.rel_path: r for r in listing.manifest(spark, str(tmp_path)).collect()}
    assert set(got) == set(NAMES)
    assert got["_skip.bin"].mtime_ns == 1234567890123456789 and got["ü.png"].size_bytes == 5
    assert listing.manifest(spark, str(tmp_path), True).where("rel_path = 'a b#%.bin'").first().content == b"xx"
    rows = {os.path.basename(r.rel_path): r for r in listing.listed(spark, [str(tmp_path / "ü.png"), str(tmp_path / "none")]).collect()}
    assert rows["ü.png"]["_error"] is None and rows["none"]["_error"]


def test_headers(spark):
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (6).to_bytes(3, "little") + (8).to_bytes(3, "little")
    images = {"a": (png(3, 2), (3, 2, "PNG")), "b": (jpeg(5, 4), (5, 4, "JPEG")), "c": (b"GIF89a" + struct.pack("<HH", 7, 6), (7, 6, "GIF")), "d": (b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -8), (9, 8, "BMP")), "e": (webp, (7, 9, "WEBP"))}
    bad = {"x": b"", "y": b"\xff\xd8\xff", "z": b"text", "w": png(1, 1)[:14]}
    df = spark.createDataFrame([(k, v[0]) for k, v in images.items()] + list(bad.items()) + [("n", None)], "rel_path string, content binary")
    got = {r.rel_path: r for r in headers.headers(df).collect()}
    assert {k: (got[k].width, got[k].height, got[k].format) for k in images} == {k: v[1] for k, v in images.items()}
    assert all(got[k]["_error"] and got[k].width is None for k in [*bad, "n"])
    assert headers.valid(df).count() == len(images)


def test_whole_content(spark):
    good = [png(3, 2), png(40, 40), jpeg(5, 4) + b"\xff\xda\x00\x02\x01\xff\xd9"]
    gif = b"GIF89a" + struct.pack("<HH", 1, 1) + b"\0\0\0" + b"\x2c" + b"\0" * 9 + b"\x02\x02\x4c\x01\0" + b"\x3b"
    bmp = b"BM" + struct.pack("<I", 30) + b"\0" * 4 + struct.pack("<I", 26) + b"\0" * 4 + struct.pack("<ii", 1, 1) + b"\0" * 4
    body = b"VP8L" + struct.pack("<I", 6) + b"\x2f" + (0).to_bytes(4, "little") + b"\0"
    webp = b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    for b in [*good, gif, bmp, webp]:
        headers.probe(b)
        headers._WHOLE[headers.probe(b)[2]](b)
        with pytest.raises(ValueError):
            headers.check(b[:-3])
    broken = bytearray(png(9, 9))
    broken[-20] ^= 1
    rows = [("whole", png(9, 9)), ("cut", png(9, 9)[:-20]), ("changed", bytes(broken)), ("none", None)]
    got = {r.rel_path: r["_error"] for r in headers.checked(spark.createDataFrame(rows, "rel_path string, content binary")).collect()}
    assert got["whole"] is None and all(got[k] for k in ("cut", "changed", "none"))


def test_contents_reads_only_what_is_named(spark, tmp_path):
    write(tmp_path, {"a/b/c/x": b"1", "a/y": b"2", "z": b"3"})
    some = spark.createDataFrame([("a/b/c/x", 7), ("none", 8)], "rel_path string, n long")
    assert {(r.rel_path, r.n, None if r.content is None else bytes(r.content)) for r in listing.contents(some, str(tmp_path)).collect()} == {("a/b/c/x", 7, b"1"), ("none", 8, None)}
    assert {r.rel_path for r in listing.manifest(spark, str(tmp_path)).collect()} == {"a/b/c/x", "a/y", "z"}


def test_store_keeps_other_models_and_whole_versions(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "img", str(tmp_path / "store")
    write(root, {"a.png": png(2, 2)})
    step = lambda **k: encode.update_store(spark, listing.manifest(spark, str(root)), str(root), store, **k)
    monkeypatch.setitem(encode.ENCODERS, "second", encode.StandIn)
    step()
    step(model_id="second", dtype="fp16")
    assert {r.model_id for r in encode.read_store(spark, store).collect()} == {"stand-in", "second"}
    one, two = (encode.read_store(spark, store, m).first().embedding for m in ("stand-in", "second"))
    assert one != two and np.allclose(one, two, atol=1e-2)
    # a version without its end mark is no version
    os.makedirs(tmp_path / "store/v9")
    assert encode.read_store(spark, store).count() == 2
    assert (tmp_path / "store/v1/model_id=second").is_dir()


def test_archives(spark):
    rows = [("d/a.png.npz", npz.dump([1, 2.5])), ("b.npz", b"broken"), ("c.txt", b""), ("e.NPZ", npz.dump([1]))]
    df = spark.createDataFrame(rows, "rel_path string, content binary")
    got = {r.rel_path: r for r in npz.load(df).collect()}
    assert set(got) == {"d/a.png", "b"} and got["d/a.png"].embedding == [1.0, 2.5] and got["b"]["_error"]
    assert npz.loaded(df).count() == 1


def test_store_follows_its_files(spark, tmp_path):
    root, store = tmp_path / "img", str(tmp_path / "store")
    write(root, {"a.png": png(2, 2), "_b.png": png(2, 2), "bad.jpg": b"no image", "x/c.png": png(4, 4, 9)})
    step = lambda **k: encode.update_store(spark, listing.manifest(spark, str(root)), str(root), store, **k)
    assert step() == {"encoded": 3, "failed": 1, "orphans": 0}
    assert step()["encoded"] == 0
    (root / "a.png").unlink()
    write(root, {"d.png": png(1, 1)})
    assert step() == {"encoded": 1, "failed": 1, "orphans": 1}
    assert {r.rel_path for r in encode.read_store(spark, store).collect()} == {"_b.png", "x/c.png", "d.png"}
    assert step(force=True)["encoded"] == 3
    with pytest.raises(catalog.EmptyStoreError):
        catalog.require(encode.read_store(spark, store, "other"))
    v = {r.rel_path: r.embedding for r in encode.read_store(spark, store).collect()}
    assert len(v["d.png"]) == 64 and abs(np.linalg.norm(v["d.png"]) - 1) < 1e-5
    assert encode.number_format("FLOAT16") == "fp16" and encode.number_format(None, "cuda:0") == "fp16" and encode.number_format(None) == "fp32"


def test_moves(spark, tmp_path):
    write(tmp_path, {"a/x": b"1", "y": b"2"})
    plan = spark.createDataFrame([("a/x", "trash/a/x"), ("none", "trash/none")], "rel_path string, target string")
    assert {r.status for r in sinks.move(plan, str(tmp_path), dry_run=True).collect()} == {"would move"}
    assert (tmp_path / "a/x").exists() and not (tmp_path / "trash").exists()
    assert {r.rel_path: r.status for r in sinks.move(plan, str(tmp_path)).collect()} == {"a/x": "moved", "none": "failed"}
    assert (tmp_path / "trash/a/x").read_bytes() == b"1"
    assert sinks.move(plan.where("rel_path = 'a/x'"), str(tmp_path)).first().status == "moved"


@pytest.mark.parametrize("mode", sinks.MODES)
def test_materialise(spark, tmp_path, mode):
    write(tmp_path / "in", {"d/x": b"1"})
    names = spark.createDataFrame([("d/x", "d_x")], "rel_path string, file_name string")
    out = str(tmp_path / "out")
    assert sinks.materialise(names, str(tmp_path / "in"), out, mode).first().status == mode
    assert sinks.materialise(names, str(tmp_path / "in"), out, mode).first().status == "kept"
    assert (tmp_path / "out/d_x").read_bytes() == b"1"
    assert os.path.islink(tmp_path / "out/d_x") == (mode == "symlink")


def test_command_line(spark, tmp_path, capsys):
    base, new = tmp_path / "base", tmp_path / "new"
    write(base, {"a.png": png(2, 2), "b.png": png(2, 2), "c.png": png(3, 3)})
    write(new, {"n.png": png(3, 3), "m.png": png(5, 5)})
    run = lambda *a: cli.main([*map(str, a)], spark)
    assert run("dedupe", "-i", base, "-d", tmp_path / "s1", "-n") == 1
    assert run("store-test", "-i", base, "-d", tmp_path / "s1") == 0
    assert run("dedupe", "-i", base, "-d", tmp_path / "s1", "-t", tmp_path / "trash", "--skip-update", "-n") == 0
    assert "would move" in capsys.readouterr().out and len(os.listdir(base)) == 3
    assert run("dedupe", "-i", base, "-d", tmp_path / "s1", "-t", tmp_path / "trash", "-kl", "Newest") == 0
    out = capsys.readouterr().out
    assert "Found 1 duplicates for a.png:\n  b.png 0.000000\n" in out and "Processed 3 images, 2 duplicates." in out
    assert len(os.listdir(base)) == 2 and len(os.listdir(tmp_path / "trash")) == 1
    assert run("import-dedupe", "-bi", base, "-bd", tmp_path / "s1", "-ii", new, "-id", tmp_path / "s2", "-t", tmp_path / "trash2") == 0
    assert os.listdir(new) == ["m.png"] and os.listdir(tmp_path / "trash2") == ["n.png"]
    assert run("encode-test", base / "c.png", new / "m.png", new / "none.png") == 0
    assert "none.png: " in capsys.readouterr().out


def test_caption_command(spark, tmp_path):
    write(tmp_path / "in", {"d/x.png": png(1, 1), "d/x.txt": b" a cat, on a mat \n", "y.png": png(1, 1)})
    assert cli.main(["captions", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    rows = spark.read.json(str(tmp_path / "out/metadata.jsonl")).collect()
    assert [(r.file_name, r.text) for r in rows] == [("d_x.png", "a cat, on a mat")]
    assert os.listdir(tmp_path / "out/images") == ["d_x.png"]
    assert cli.main(["captions", str(tmp_path / "in"), str(tmp_path / "out"), "--clip-model", "stand-in", "--mode", "hardlink"], spark) == 0


def test_stream(spark, tmp_path):
    from twinsift.streaming.incoming import match_stream

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows.where("vec_id % 2 = 1").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = match_stream(stream, rows.where("vec_id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck"), 1.1)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 45 and got.select("batch").distinct().count() == 3
    assert got.where(F.col("dist") > 1.1).count() == 0
