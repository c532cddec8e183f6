"""File formats: PNG, palette files, checksums, embedded payloads. Bytes are made and read in batches (Arrow)."""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PNG_HEAD = b"\x89PNG\r\n\x1a\n"
PAYLOAD = re.compile(r'hts:payload="([^"]*)"')


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(rgba: np.ndarray, level: int = 6) -> bytes:
    """8 bits a channel; without alpha if all is opaque. Each line is stored as it is or as what changed from the one
    above, whichever has the smaller sum of signed magnitudes."""
    h, w, _ = rgba.shape
    if (rgba[..., 3] == 255).all():
        rgba = rgba[..., :3]
    lines = np.ascontiguousarray(rgba, np.uint8).reshape(h, -1)
    up = lines - np.concatenate([np.zeros((1, lines.shape[1]), np.uint8), lines[:-1]])
    cost = lambda v: np.abs(v.view(np.int8).astype(np.int32)).sum(1)
    better = cost(up) < cost(lines)
    body = np.concatenate([np.where(better, 2, 0).astype(np.uint8)[:, None], np.where(better[:, None], up, lines)], 1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if rgba.shape[2] == 3 else 6, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit RGB or RGBA file with any line filters."""
    at, idat, w, h, bpp = 8, b"", 0, 0, 4
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        own = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + own) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            w, h, bits, kind_, *_ = struct.unpack(">IIBBBBB", own)
            if bits != 8 or kind_ not in (2, 6):
                raise ValueError("only 8-bit RGB and RGBA are read")
            bpp = 3 if kind_ == 2 else 4
        elif kind == b"IDAT":
            idat += own
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), np.uint8)
    for y in range(h):
        kind_, line = raw[y, 0], raw[y, 1:].astype(int)
        above = out[y - 1].astype(int) if y else np.zeros(w * bpp, int)
        if kind_ == 0:
            out[y] = line
        elif kind_ == 2:
            out[y] = (line + above) & 255
        else:
            for i in range(w * bpp):
                a, b, c = (int(out[y, i - bpp]) if i >= bpp else 0), int(above[i]), (int(above[i - bpp]) if i >= bpp else 0)
                p = a + b - c
                guess = a if kind_ == 1 else (a + b) // 2 if kind_ == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, i] = (line[i] + guess) & 255
    rgba = out.reshape(h, w, bpp)
    return np.concatenate([rgba, np.full((h, w, 1), 255, np.uint8)], 2) if bpp == 3 else rgba


def images_to_png(px: DataFrame) -> DataFrame:
    """image_id, width, height, png: one row an image."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y = (np.asarray(t.column(c).combine_chunks()) for c in "xy")
        picture = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
        picture[y, x] = np.stack([np.asarray(t.column(c).combine_chunks()) for c in "rgba"], 1)
        h, w, _ = picture.shape
        return pa.table({"image_id": [key[0].as_py()], "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "png": [encode_png(picture)]})

    return px.select("image_id", "x", "y", *"rgba").groupBy("image_id").applyInArrow(run, "image_id string, width int, height int, png binary")


def png_to_images(files: DataFrame) -> DataFrame:
    """Pixels of files (image_id, png)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("image_id").to_pylist(), batch.column("png").to_pylist(), strict=True):
                p = decode_png(data)
                h, w, _ = p.shape
                y, x = np.mgrid[0:h, 0:w]
                cols = [pa.array([name] * (h * w), pa.string()), pa.array(x.ravel(), pa.int64()), pa.array(y.ravel(), pa.int64()), *(pa.array(p[..., k].ravel().astype(np.int64)) for k in range(4))]
                yield pa.RecordBatch.from_arrays(cols, ["image_id", "x", "y", *"rgba"])

    return files.select("image_id", "png").mapInArrow(run, "image_id string, x long, y long, r long, g long, b long, a long")


def encode_act(colours: list[tuple[int, int, int]]) -> bytes:
    """256 entries, then their number and no transparent one."""
    own = colours[:256]
    return bytes(v for c in own for v in c).ljust(768, b"\0") + struct.pack(">HH", len(own), 0xFFFF)


def decode_act(data: bytes) -> list[tuple[int, int, int]]:
    if len(data) < 768:
        raise ValueError("too short for a colour table")
    n = struct.unpack(">H", data[768:770])[0] if len(data) >= 770 else 256
    return [tuple(data[3 * i : 3 * i + 3]) for i in range(n if 1 <= n <= 256 else 256)]


def encode_ase(colours: list[tuple[int, int, int]], group: str = "Palette") -> bytes:
    def name(text: str) -> bytes:
        return struct.pack(">H", len(text) + 1) + text.encode("utf-16-be") + b"\0\0"

    blocks = [(0xC001, name(group))]
    blocks += [(0x0001, name("#%02X%02X%02X" % c) + b"RGB " + struct.pack(">fffH", *(v / 255 for v in c), 0)) for c in colours]
    blocks.append((0xC002, b""))
    return b"ASEF" + struct.pack(">HHI", 1, 0, len(blocks)) + b"".join(struct.pack(">HI", k, len(d)) + d for k, d in blocks)


def decode_ase(data: bytes) -> list[tuple[int, int, int]]:
    """RGB, grey and plain CMYK entries; others are passed over; none at all is an error."""
    if data[:4] != b"ASEF":
        raise ValueError("not a swatch file")
    out, at = [], 12
    put = lambda *c: out.append(tuple(int(min(1, max(0, v)) * 255 + 0.5) for v in c))
    for _ in range(struct.unpack(">I", data[8:12])[0]):
        kind, n = struct.unpack(">HI", data[at : at + 6])
        own, at = data[at + 6 : at + 6 + n], at + 6 + n
        if kind != 1:
            continue
        p = 2 + 2 * struct.unpack(">H", own[:2])[0]
        model, p = own[p : p + 4], p + 4
        if model == b"RGB ":
            put(*struct.unpack(">fff", own[p : p + 12]))
        elif model in (b"GRAY", b"Gray"):
            put(*struct.unpack(">f", own[p : p + 4]) * 3)
        elif model == b"CMYK":
            c, m, y, k = struct.unpack(">ffff", own[p : p + 16])
            put((1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k))
    if not out:
        raise ValueError("no colours")
    return out


def palette_files(spark, path: str) -> DataFrame:
    """path, idx, r, g, b of all .act and .ase files in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = (decode_act if name.lower().endswith(".act") else decode_ase)(data)
                cols = [pa.array([name] * len(found)), pa.array(range(len(found)), pa.int32()), *(pa.array([c[k] for c in found], pa.int32()) for k in range(3))]
                yield pa.RecordBatch.from_arrays(cols, ["path", "idx", *"rgb"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{act,ase}").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, idx int, r int, g int, b int")


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"\s", ""))


def encode_text(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def decode_text(code: Column) -> Column:
    """Characters outside the alphabet are passed over."""
    return F.decode(F.unbase64(F.regexp_replace(code, "[^A-Za-z0-9+/=]", "")), "UTF-8")


def build_xmp(record: dict) -> str:
    return f'<rdf:Description hts:payload="{base64.b64encode(json.dumps(record).encode()).decode()}"/>'


def parse_xmp(xmp: Column, schema: str) -> Column:
    """The embedded record as a struct; null if there is none or it can't be read."""
    code = F.regexp_extract(xmp, PAYLOAD.pattern, 1)
    safe = F.when(code.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(code) % 4 == 0), code)
    return F.from_json(F.decode(F.unbase64(safe), "UTF-8"), schema)
