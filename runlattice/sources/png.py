"""Masks and label maps from 8-bit grayscale PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions import kernels, masks

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def read_gray(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grayscale PNG without interlacing; anything else is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    if depth != 8 or colour != 0 or interlace:
        raise ValueError("only 8-bit grayscale without interlacing")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != h * (w + 1):
        raise ValueError("pixels are missing")
    rows = raw.reshape(h, w + 1) if h else raw.reshape(0, w + 1)
    out = np.zeros((h, w), np.uint8)
    above = np.zeros(w, np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:], above)
    return out


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes a row filter: none, left, above, mean of both, or the nearest of left, above and corner to their plane."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, dtype=np.uint8)
    if kind == 2:
        return row + above
    out, left, corner = [], 0, 0
    for v, up in zip(row.tolist(), above.tolist()):
        if kind == 3:
            guess = (left + up) >> 1
        elif kind == 4:
            plane = left + up - corner
            guess = min((abs(plane - left), 0, left), (abs(plane - up), 1, up), (abs(plane - corner), 2, corner))[2]
        else:
            raise ValueError("unknown row filter")
        left, corner = (v + guess) & 255, up
        out.append(left)
    return np.array(out, np.uint8)


def write_gray(a: np.ndarray) -> bytes:
    """An 8-bit grayscale PNG, rows unfiltered."""
    a = np.asarray(a, np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.hstack([np.zeros((a.shape[0], 1), np.uint8), a]).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def from_png(data: masks.ColumnLike, threshold: int = 1) -> Column:
    """A mask column from a column of PNG bytes: foreground where the value is threshold or more."""
    return masks.apply(lambda b: kernels.from_dense(read_gray(b) >= threshold), masks.MASK, data)


def to_png(m: masks.ColumnLike, value: int = 255) -> Column:
    return masks.apply(lambda a: write_gray(kernels.dense(a) * np.uint8(value)), "binary", m)


def label_masks(data: masks.ColumnLike) -> Column:
    """array<struct<label,mask>>-like pair of arrays from PNG bytes: labels, and the masks of these in order."""
    labels = masks.apply(lambda b: [int(v) for v in np.unique(read_gray(b)) if v], "array<int>", data)
    each = masks.apply(lambda b: [kernels.from_dense(a == v) for a in [read_gray(b)] for v in np.unique(a) if v], f"array<{masks.MASK}>", data)
    return F.arrays_zip(labels.alias("label"), each.alias("mask"))


def read_masks(spark: SparkSession, path: str, threshold: int = 1) -> DataFrame:
    """path, mask of every PNG file under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", from_png("content", threshold).alias("mask"))


def read_label_maps(spark: SparkSession, path: str) -> DataFrame:
    """path, label, mask of every label above 0 in every PNG file under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", F.inline(label_masks("content")))
