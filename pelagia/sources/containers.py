"""Small readers for what is written inside media files: one file in, one struct out; pixels are never read, sound of WAV files only.

Readers seek, so of a file that is opened by its path only headers are read; contents that a scan has read
already work as well. What can't be read of a file is left out, and damage beyond that is the file's error.
"""

from __future__ import annotations

import base64
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, width int, height int, animated boolean, duration double, peaks array<int>, texts map<string,string>, error string"
COVER_SCHEMA = "path string, mime string, cover binary"
MOST_BYTES = 16 << 20
LONGEST_SECONDS = 7 * 86400
MAKE, MODEL, EXIF_PART, USER_COMMENT = 271, 272, 0x8769, 37510


def number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _inflated(data: bytes) -> bytes:
    return zlib.decompressobj().decompress(data, MOST_BYTES)


def _png(f: BinaryIO) -> dict:
    """Size and text chunks; a damaged text is left out, the others stay."""
    f.seek(16)
    out: dict = {"width": number(f.read(4)), "height": number(f.read(4)), "texts": {}}
    at = 8
    while len(head := (f.seek(at), f.read(8))[1]) == 8:
        size, kind = number(head[:4]), head[4:]
        if kind == b"acTL":
            out["animated"] = number(f.read(4)) > 1
        if kind in (b"tEXt", b"zTXt", b"iTXt") and size <= MOST_BYTES:
            name, _, rest = f.read(size).partition(b"\0")
            try:
                if kind == b"iTXt":
                    text = rest[2:].split(b"\0", 2)[2]
                    value = (_inflated(text) if rest[0] else text).decode("utf-8", "replace")
                else:
                    value = (_inflated(rest[1:]) if kind == b"zTXt" else rest).decode("latin-1")
                out["texts"][name.decode("latin-1")] = value
            except (zlib.error, IndexError):
                pass
        at += size + 12
    return out


def _boxes(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes between two places; their contents are not read."""
    while at + 8 <= end:
        f.seek(at)
        head = f.read(16)
        size, kind, skip = number(head[:4]), head[4:8], 8
        if size == 1:
            size, skip = number(head[8:16]), 16
        size = size or end - at
        if size < skip:
            return
        yield kind, at + skip, min(end, at + size)
        at += size


def _mp4(f: BinaryIO) -> dict:
    end = f.seek(0, io.SEEK_END)
    found = next(((a, b) for kind, a, b in _boxes(f, 0, end) if kind == b"moov"), None)
    if not found or found[1] - found[0] > MOST_BYTES:
        return {"texts": {}}
    f.seek(found[0])
    data = f.read(found[1] - found[0])
    return _moov(data)


def _moov(data: bytes) -> dict:
    out: dict = {"texts": {}}
    keys: list[str] = []
    inside = io.BytesIO(data)

    def visit(start: int, stop: int, path: tuple) -> None:
        for kind, a, b in list(_boxes(inside, start, stop)):
            if kind in (b"trak", b"udta", b"ilst") or path[-1:] == (b"ilst",):
                visit(a, b, (*path, kind))
            elif kind == b"meta":
                visit(a + 4 if data[a : a + 4] == b"\0\0\0\0" else a, b, (*path, kind))
            elif kind == b"mvhd":
                scale, ticks = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
                unknown = (1 << (64 if data[a] else 32)) - 1
                if scale and ticks != unknown and 0 < ticks / scale < LONGEST_SECONDS:
                    out["duration"] = ticks / scale
            elif kind == b"tkhd" and "width" not in out:
                width, height = struct.unpack_from(">II", data, b - 8)
                if width >> 16 and height >> 16:
                    out["width"], out["height"] = width >> 16, height >> 16
            elif kind == b"keys":
                at = a + 8
                while at + 8 <= b:
                    size = number(data[at : at + 4])
                    keys.append(data[at + 8 : at + size].decode("utf-8", "replace"))
                    at += max(8, size)
            elif kind == b"data" and path[-2:-1] == (b"ilst",):
                place = number(path[-1])
                name = keys[place - 1] if 0 < place <= len(keys) else path[-1].decode("latin-1")
                out["texts"][name] = data[a + 8 : b].decode("utf-8", "replace")

    visit(0, len(data), (b"moov",))
    return out


def _seven_bits(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _id3_frames(f: BinaryIO) -> Iterator[tuple[str, bytes]]:
    f.seek(0)
    head = f.read(10)
    data = f.read(min(_seven_bits(head[6:10]), MOST_BYTES))
    at = 0
    while at + 10 <= len(data) and data[at]:
        size = _seven_bits(data[at + 4 : at + 8]) if head[3] == 4 else number(data[at + 4 : at + 8])
        yield data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
        at += 10 + size


def _id3(f: BinaryIO) -> dict:
    texts = {}
    for kind, body in _id3_frames(f):
        if kind[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").rstrip("\0")
            name, _, value = text.partition("\0")
            texts[name if kind == "TXXX" else kind] = value if kind == "TXXX" else text
    return {"texts": texts}


def _id3_cover(f: BinaryIO) -> tuple[str, bytes] | None:
    """The front cover, else the first picture."""
    found = []
    for kind, body in _id3_frames(f):
        if kind == "APIC" and body:
            mime, _, rest = body[1:].partition(b"\0")
            end = b"\0\0" if body[0] in (1, 2) else b"\0"
            at = rest.find(end, 1)
            while body[0] in (1, 2) and at > 0 and (at - 1) % 2:  # two bytes a character
                at = rest.find(end, at + 1)
            if at > 0:
                found.append((rest[0] != 3, mime.decode("latin-1"), rest[at + len(end) :]))
    return min(found, key=lambda x: x[0])[1:] if found else None


def _flac_blocks(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    at, last = 4, False
    while not last and len(head := (f.seek(at), f.read(4))[1]) == 4:
        last, kind, size = bool(head[0] & 128), head[0] & 127, number(head[1:])
        yield kind, f.read(size) if kind in (0, 4, 6) else b""
        at += 4 + size


def _comments(body: bytes) -> Iterator[tuple[str, str]]:
    at = 4 + int.from_bytes(body[:4], "little")
    n, at = int.from_bytes(body[at : at + 4], "little"), at + 4
    for _ in range(min(n, len(body) // 4)):
        size = int.from_bytes(body[at : at + 4], "little")
        name, _, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        yield name.lower(), value
        at += 4 + size


def _flac(f: BinaryIO) -> dict:
    out: dict = {"texts": {}}
    for kind, body in _flac_blocks(f):
        if kind == 0 and len(body) >= 18:
            packed = number(body[10:18])
            rate, samples = packed >> 44, packed & (1 << 36) - 1
            if rate and samples:
                out["duration"] = samples / rate
        elif kind == 4:
            out["texts"] |= {k: v for k, v in _comments(body) if k != "metadata_block_picture"}
    return out


def _picture(body: bytes) -> tuple[int, str, bytes]:
    mime = number(body[4:8])
    words = number(body[8 + mime : 12 + mime])
    at = 12 + mime + words + 16
    return number(body[:4]), body[8 : 8 + mime].decode("latin-1"), body[at + 4 : at + 4 + number(body[at : at + 4])]


def _flac_cover(f: BinaryIO) -> tuple[str, bytes] | None:
    found = []
    for kind, body in _flac_blocks(f):
        if kind == 6:
            found.append(_picture(body))
        elif kind == 4:
            found += [_picture(base64.b64decode(v)) for k, v in _comments(body) if k == "metadata_block_picture"]
    return min(found, key=lambda x: x[0] != 3)[1:] if found else None


def _tiff_texts(data: bytes) -> dict[str, str]:
    """A graph in the maker's or model's name, and the user comment as parameters."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None:
        return {}
    read = lambda at, size: int.from_bytes(data[at : at + size], order)

    def values(at: int) -> dict[int, bytes]:
        out = {}
        for i in range(read(at, 2)):
            entry = at + 2 + 12 * i
            tag, kind, n = read(entry, 2), read(entry + 2, 2), read(entry + 4, 4)
            size = n * {1: 1, 2: 1, 3: 2, 4: 4, 7: 1}.get(kind, 0)
            place = entry + 8 if size <= 4 else read(entry + 8, 4)
            out[tag] = data[place : place + size]
        return out

    first, texts = values(read(4, 4)), {}
    for tag in (MAKE, MODEL):
        name, mark, body = first.get(tag, b"").rstrip(b"\0").decode("utf-8", "replace").partition(":")
        if mark and name in ("prompt", "workflow") and body.strip().startswith("{"):
            texts.setdefault(name, body.strip())
    comment = values(int.from_bytes(first[EXIF_PART], order)).get(USER_COMMENT, b"") if EXIF_PART in first else b""
    if text := _comment(comment):
        texts["parameters"] = text
    return texts


def _comment(raw: bytes) -> str:
    """The text after its mark; of the two byte orders the one that reads as plain letters."""
    if raw.startswith(b"UNICODE"):
        plain = lambda s: sum(" " <= c <= "~" or c in "\r\n\t" for c in s)
        text = max((raw[8:].decode(x, "replace") for x in ("utf-16-be", "utf-16-le")), key=plain)
    else:
        text = (raw[8:] if raw.startswith((b"ASCII", b"\0" * 8)) else raw).decode("utf-8", "replace")
    return text.replace("\0", "").strip()


def _jpeg(f: BinaryIO) -> dict:
    out: dict = {"texts": {}}
    at = 2
    while len(head := (f.seek(at), f.read(4))[1]) == 4 and head[0] == 0xFF and head[1] != 0xDA:
        kind, size = head[1], number(head[2:])
        if kind == 0xE1:
            body = f.read(size - 2)
            out["texts"] |= _tiff_texts(body[6:]) if body.startswith(b"Exif\0\0") else {}
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = struct.unpack(">xHH", f.read(5))
        at += 2 + size
    return out


def _webp(f: BinaryIO) -> dict:
    out: dict = {"texts": {}}
    at = 12
    while len(head := (f.seek(at), f.read(8))[1]) == 8:
        kind, size = head[:4], int.from_bytes(head[4:], "little")
        body = f.read(min(size, MOST_BYTES if kind == b"EXIF" else 10))
        if kind == b"VP8X":
            out["animated"] = bool(body[0] & 2)
            out["width"], out["height"] = (int.from_bytes(body[i : i + 3], "little") + 1 for i in (4, 7))
        elif kind == b"VP8L" and "width" not in out:
            bits = int.from_bytes(body[1:5], "little")
            out["width"], out["height"] = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif kind == b"VP8 " and "width" not in out:
            out["width"], out["height"] = (int.from_bytes(body[i : i + 2], "little") & 0x3FFF for i in (6, 8))
        elif kind == b"EXIF":
            out["texts"] |= _tiff_texts(body.removeprefix(b"Exif\0\0"))
        at += 8 + size + size % 2
    return out


def _gif(f: BinaryIO) -> dict:
    f.seek(6)
    width, height, flags = struct.unpack("<HHB", f.read(5))
    at, frames = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0
    while frames < 2 and (mark := (f.seek(at), f.read(1))[1]) in (b"!", b","):
        if mark == b",":
            frames += 1
            local = f.read(9)[8]
            at += 11 + (3 << (local & 7) + 1 if local & 128 else 0)
        else:
            at += 2
        while size := (f.seek(at), f.read(1))[1]:
            at += 1 + size[0]
            if not size[0]:
                break
    return {"width": width, "height": height, "animated": frames > 1, "texts": {}}


PEAKS, LEAST_SECONDS = 96, 0.1


def _wav(f: BinaryIO) -> dict:
    """Duration, and the loudest sample of each of PEAKS stretches in hundredths of the loudest of all; 16-bit sound only.

    The samples are read stretch by stretch.
    """
    out: dict = {"texts": {}}
    at, layout = 12, None
    while len(head := (f.seek(at), f.read(8))[1]) == 8:
        kind, size = head[:4], int.from_bytes(head[4:], "little")
        if kind == b"fmt " and len(body := f.read(16)) == 16:
            layout = struct.unpack("<HHIIHH", body)
        elif kind == b"data" and layout:
            coding, channels, rate, _, frame, bits = layout
            frames = size // frame if frame else 0
            if rate and frames / rate >= LEAST_SECONDS:
                out["duration"] = frames / rate
                if (coding, bits) == (1, 16):
                    cuts = [at + 8 + frames * i // PEAKS * frame for i in range(PEAKS + 1)]
                    loud = [max((abs(int(x)) for x in _samples(f, a, b)), default=0) for a, b in zip(cuts, cuts[1:], strict=False)]
                    out["peaks"] = [round(100 * x / (max(loud) or 1)) for x in loud]
        at += 8 + size + size % 2
    return out


def _samples(f: BinaryIO, start: int, end: int) -> np.ndarray:
    """The extremes of a stretch of 16-bit samples."""
    f.seek(start)
    least = most = 0
    while start < end and (data := f.read(min(end - start, 1 << 20))):
        part = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        if len(part):
            least, most = min(least, int(part.min())), max(most, int(part.max()))
        start += len(data)
    return np.array([least, most])


def _reader(f: BinaryIO):
    f.seek(0)
    start = f.read(12)
    marks = [(0, b"\x89PNG\r\n\x1a\n", _png), (4, b"ftyp", _mp4), (0, b"ID3", _id3), (0, b"fLaC", _flac), (0, b"\xff\xd8", _jpeg), (0, b"GIF8", _gif), (8, b"WEBP", _webp), (8, b"WAVE", _wav)]
    return next((read for at, mark, read in marks if start[at:].startswith(mark)), lambda _: {"texts": {}})


def describe(source: bytes | BinaryIO) -> dict:
    """What a file says about itself; the reader is chosen by the first bytes."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    return _reader(f)(f)


def cover_of(source: bytes | BinaryIO) -> tuple[str, bytes] | None:
    """(mime, picture) of the cover inside a sound file."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    read = {_id3: _id3_cover, _flac: _flac_cover}.get(_reader(f))
    return read(f) if read else None


def with_text(png: bytes, texts: dict[str, str]) -> bytes:
    """The PNG with these texts before its pixels, in place of older ones of the same names; all else stays byte for byte."""
    out, at, done = [png[:8]], 8, False
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    while at + 8 <= len(png):
        size, kind = number(png[at : at + 4]), png[at + 4 : at + 8]
        whole = png[at : at + size + 12]
        if kind == b"IDAT" and not done:
            for name, value in texts.items():
                latin = all(ord(c) < 256 for c in value)
                out.append(chunk(b"tEXt", name.encode("latin-1") + b"\0" + value.encode("latin-1")) if latin else chunk(b"iTXt", name.encode("latin-1") + b"\0\0\0\0\0" + value.encode()))
            done = True
        if not (kind in (b"tEXt", b"zTXt", b"iTXt") and whole[8:].partition(b"\0")[0].decode("latin-1") in texts):
            out.append(whole)
        at += size + 12
    return b"".join(out)


def _opened(batch: pd.DataFrame) -> Iterator[tuple[str, BinaryIO | Exception]]:
    for i, path in enumerate(batch["path"]):
        if "content" in batch:
            yield path, io.BytesIO(bytes(batch["content"].iloc[i] or b""))
            continue
        try:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                yield path, f
        except OSError as problem:
            yield path, problem


def extract(files: DataFrame) -> DataFrame:
    """One row for each row of files (path and, if it was read, content); a file that can't be read has its error and stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, f in _opened(batch):
                try:
                    if isinstance(f, Exception):
                        raise f
                    found, error = describe(f), None
                except Exception as problem:  # noqa: BLE001  any damage in a file is that file's result
                    found, error = {"texts": {}}, f"{type(problem).__name__}: {problem}"[:200]
                rows.append((path, found.get("width"), found.get("height"), found.get("animated"), found.get("duration"), found.get("peaks"), found["texts"], error))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "animated", "duration", "peaks", "texts", "error"]).astype({"width": "Int32", "height": "Int32", "duration": "Float64", "animated": "boolean"})

    return files.select(*(c for c in ("path", "content") if c in files.columns)).mapInPandas(run, SCHEMA)


def covers(files: DataFrame) -> DataFrame:
    """(path, mime, cover) of the sound files that have one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, f in _opened(batch):
                try:
                    found = None if isinstance(f, Exception) else cover_of(f)
                except (ValueError, IndexError, struct.error):
                    found = None
                if found:
                    rows.append((path, *found))
            yield pd.DataFrame(rows, columns=["path", "mime", "cover"])

    return files.select(*(c for c in ("path", "content") if c in files.columns)).mapInPandas(run, COVER_SCHEMA)


def export_png(rows: DataFrame) -> DataFrame:
    """(path, content) of rows (path, content, parameters): the pictures with their settings text written into them."""

    @F.pandas_udf("binary")
    def spliced(contents: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else with_text(bytes(c), {"parameters": t}) if t and bytes(c[:4]) == b"\x89PNG" else bytes(c) for c, t in zip(contents, texts, strict=True)])

    return rows.select("path", spliced("content", "parameters").alias("content"))
