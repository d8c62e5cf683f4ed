"""Width, height and format of images from the first bytes of their content, whatever their names say; and whether the
whole content is there: check() walks the parts that the format is made of, and decodes where Pillow can be imported."""

from __future__ import annotations

import io
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame


def _jpeg(b: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            raise ValueError("no JPEG marker")
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        elif mark in (0x01, *range(0xD0, 0xD9)):
            at += 2
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    raise ValueError("no JPEG frame")


def _webp(b: bytes) -> tuple[int, int]:
    kind = b[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if kind == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L" and b[20] == 0x2F:
        n = int.from_bytes(b[21:25], "little")
        return 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF)
    raise ValueError("no WebP frame")


def probe(b: bytes | None) -> tuple[int, int, str]:
    """Width, height and format; ValueError where the bytes are no image that is known here."""
    b = b or b""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR":
            return (*struct.unpack(">II", b[16:24]), "PNG")
        if b[:2] == b"\xff\xd8":
            return (*_jpeg(b), "JPEG")
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", b[6:10]), "GIF")
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            return w, abs(h), "BMP"
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return (*_webp(b), "WEBP")
    except (struct.error, IndexError) as e:
        raise ValueError(f"cut off: {e}") from e
    raise ValueError("unknown format")


def _whole_png(b: bytes) -> None:
    at, data = 8, zlib.decompressobj()
    seen = False
    while True:
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        body, crc = b[at + 8 : at + 8 + n], b[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError("broken PNG chunk")
        if kind == b"IDAT":
            data.decompress(body)
            seen = True
        if kind == b"IEND":
            break
        at += 12 + n
    if not seen or not data.eof:
        raise ValueError("PNG data end early")


def _whole_jpeg(b: bytes) -> None:
    if b.rstrip(b"\0")[-2:] != b"\xff\xd9" and b"\xff\xd9" not in b[-4096:]:
        raise ValueError("JPEG has no end")
    if b"\xff\xda" not in b:
        raise ValueError("JPEG has no scan")


def _whole_gif(b: bytes) -> None:
    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(at: int) -> int:
        while b[at]:
            at += 1 + b[at]
        return at + 1

    at, images = 13 + table(b[10]), 0
    while b[at] != 0x3B:
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C:
            at, images = blocks(at + 11 + table(b[at + 9])), images + 1
        else:
            raise ValueError("unknown GIF block")
    if not images:
        raise ValueError("GIF without an image")


def _whole_bmp(b: bytes) -> None:
    if len(b) < struct.unpack("<I", b[2:6])[0] or len(b) < struct.unpack("<I", b[10:14])[0]:
        raise ValueError("BMP ends early")


def _whole_webp(b: bytes) -> None:
    if len(b) < 8 + struct.unpack("<I", b[4:8])[0]:
        raise ValueError("WebP ends early")
    at, kinds = 12, set()
    while at + 8 <= len(b):
        kinds.add(b[at : at + 4])
        n = struct.unpack("<I", b[at + 4 : at + 8])[0]
        at += 8 + n + n % 2
    if not kinds & {b"VP8 ", b"VP8L", b"ANMF"}:
        raise ValueError("WebP without an image")


_WHOLE = {"PNG": _whole_png, "JPEG": _whole_jpeg, "GIF": _whole_gif, "BMP": _whole_bmp, "WEBP": _whole_webp}


def check(b: bytes | None) -> tuple[int, int, str]:
    """probe(), and ValueError too where the content ends early or is broken."""
    found = probe(b)
    try:
        _WHOLE[found[2]](b)
    except (struct.error, IndexError, zlib.error) as e:
        raise ValueError(f"broken {found[2]}: {e}") from e
    pixels(b)
    return found


def pixels(b: bytes):
    """The content as a decoded RGB image where Pillow can be imported, else the bytes themselves; ValueError where decoding fails."""
    try:
        from PIL import Image
    except ImportError:
        return b
    try:
        return Image.open(io.BytesIO(b)).convert("RGB")
    except Exception as e:  # noqa: BLE001  whatever a decoder raises is the image's error
        raise ValueError(f"{type(e).__name__}: {e}") from e


def headers(files: DataFrame) -> DataFrame:
    """rel_path, width, height, format and _error of files (rel_path, content)."""

    def run(frames):
        for f in frames:
            out = []
            for path, content in zip(f.rel_path, f.content, strict=True):
                try:
                    out.append((path, *probe(content), None))
                except ValueError as e:
                    out.append((path, None, None, None, str(e)))
            p = pd.DataFrame(out, columns=["rel_path", "width", "height", "format", "_error"])
            yield p.astype({"width": "Int64", "height": "Int64"})

    return files.select("rel_path", "content").mapInPandas(run, "rel_path string, width long, height long, format string, _error string")


def checked(files: DataFrame) -> DataFrame:
    """rel_path and _error of files (rel_path, content): what check() says against the whole content, null where nothing."""

    def run(frames):
        for f in frames:
            out = []
            for path, content in zip(f.rel_path, f.content, strict=True):
                try:
                    check(content)
                    out.append((path, None))
                except ValueError as e:
                    out.append((path, str(e)))
            yield pd.DataFrame(out, columns=["rel_path", "_error"])

    return files.select("rel_path", "content").mapInPandas(run, "rel_path string, _error string")


def valid(files: DataFrame) -> DataFrame:
    """Files whose header can be read; the others are in headers() with their _error."""
    return files.join(headers(files).where("_error IS NULL").select("rel_path", "width", "height", "format"), "rel_path")
