"""Image kernels over grey pixels, in NumPy: PDQ hash and quality, partition hashes and gradient histograms.

As columns they are Arrow UDFs over binary rows of pixels (row-major, one byte each) with width and height.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of 8-bit RGB pixels (..., 3) in whole numbers."""
    r, g, b = (rgb[..., i].astype(np.uint32) for i in range(3))
    return ((77 * r + 150 * g + 29 * b + 128) >> 8).astype(np.uint8)


def _axis(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(to, dtype=np.float32) + np.float32(0.5)) * np.float32(size) / np.float32(to) - np.float32(0.5), 0, size - 1).astype(np.float32)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, size - 1), at - low.astype(np.float32)


def resized(image: np.ndarray, width: int, height: int, whole: bool = True) -> np.ndarray:
    """Bilinear, pixel centres aligned, edges clamped; whole numbers (halves up) or as they come."""
    (y0, y1, fy), (x0, x1, fx) = _axis(image.shape[0], height), _axis(image.shape[1], width)
    p = image.astype(np.float32)
    mixed = [p[y][:, x0] + (p[y][:, x1] - p[y][:, x0]) * fx for y in (y0, y1)]
    out = mixed[0] + (mixed[1] - mixed[0]) * fy[:, None]
    return np.clip(np.floor(out + np.float32(0.5)), 0, 255).astype(np.uint8) if whole else out


def _box(a: np.ndarray, window: int) -> np.ndarray:
    """Means over a sliding window along the last axis, cut off at the ends."""
    n = a.shape[-1]
    sums = np.concatenate([np.zeros((*a.shape[:-1], 1)), np.cumsum(a, axis=-1, dtype=np.float64)], axis=-1)
    half = (window + 2) // 2
    lo = np.clip(np.arange(n) + half - window, 0, n)
    hi = np.clip(np.arange(n) + half, 0, n)
    return ((sums[..., hi] - sums[..., lo]) / (hi - lo)).astype(np.float32)


@cache
def _pdq_matrix() -> np.ndarray:
    k, n = np.arange(1, 17)[:, None], np.arange(64)[None, :]
    return (np.sqrt(2 / 64) * np.cos(np.pi / 128 * k * (2 * n + 1))).astype(np.float32)


def pdq(image: np.ndarray) -> tuple[bytes, int]:
    """The 256-bit hash and the quality of a grey image; below five pixels a side both are zero."""
    rows, columns = image.shape
    if rows < 5 or columns < 5:
        return bytes(32), 0
    a = image.astype(np.float32)
    if (rows, columns) != (64, 64):
        for _ in range(2):
            a = _box(a, -(-columns // 128))
            a = _box(a.T, -(-rows // 128)).T
        a = a[((np.arange(64) + 0.5) * rows / 64).astype(int)][:, ((np.arange(64) + 0.5) * columns / 64).astype(int)]
    steps = [np.trunc((x - y) * np.float32(100) / np.float32(255)) for x, y in ((a[:-1], a[1:]), (a[:, :-1], a[:, 1:]))]
    quality = min(100, int(sum(np.abs(s).sum() for s in steps)) // 90)
    m = _pdq_matrix()
    c = (m @ a @ m.T).reshape(-1)
    middle = np.sort(c)[127]
    bits = np.packbits((c > middle)[::-1])
    return bits.tobytes(), quality


@cache
def _part_matrix() -> np.ndarray:
    x, f = np.arange(32)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * f * np.pi / 64) * np.where(f == 0, np.sqrt(0.5), 1.0)


def partition_hashes(image: np.ndarray) -> list[int]:
    """Nine 64-bit hashes of a 3 x 3 partition, as signed numbers."""
    a = resized(image, 96, 96).astype(float).reshape(3, 32, 3, 32).transpose(0, 2, 1, 3).reshape(9, 32, 32)
    t = _part_matrix()
    c = (0.25 * (t.T @ a @ t)).astype(np.float32).reshape(9, 64)
    over = c > np.sort(c, axis=1)[:, 32:33]
    return np.packbits(over, axis=1, bitorder="little").copy().view("<i8").reshape(9).tolist()


def gradients(image: np.ndarray) -> list[float]:
    """A histogram of gradient directions, 4 x 4 cells of 8 directions, of norm 1 (or all 0)."""
    p = resized(image, 128, 128).astype(np.float32)
    side = p[:-2] + 2 * p[1:-1] + p[2:]
    gx = side[:, 2:] - side[:, :-2]
    flat = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gy = flat[2:] - flat[:-2]
    size = np.abs(gx) + np.abs(gy)
    angle = np.arctan2(gy.astype(float), gx.astype(float))
    angle = np.where(angle < 0, angle + np.pi, angle)
    angle = np.where(angle >= np.pi, angle - np.pi, angle)
    which = np.minimum((angle / np.pi * 8).astype(int), 7)
    cell = np.arange(1, 127) // 32
    key = (cell[:, None] * 4 + cell[None, :]) * 8 + which
    h = np.bincount(key.reshape(-1), np.where(size < 1e-6, 0, size).reshape(-1), 128)
    norm = np.sqrt((h * h).sum())
    return (h / norm if norm > 1e-9 else h).astype(np.float32).tolist()


def _image(pixels: bytes, width: int, height: int) -> np.ndarray | None:
    if pixels is None or width is None or height is None or width < 1 or height < 1 or len(pixels) != width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(int(height), int(width))


def features(pixels: Column, width: Column, height: Column) -> Column:
    """Struct of pdq (binary), quality, parts and histogram of each image; null where the pixels don't fit the size."""

    @F.pandas_udf("pdq binary, quality int, parts array<bigint>, histogram array<float>")
    def made(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for image in map(_image, p, w, h):
            rows.append((None, None, None, None) if image is None else (*pdq(image), partition_hashes(image), gradients(image)))
        return pd.DataFrame(rows, columns=["pdq", "quality", "parts", "histogram"])

    return made(pixels, width, height)


def sobel_blob(histogram: Column, header: bool = False) -> Column:
    """A gradient histogram as little-endian 32-bit floats, with the first profile's header (1, 4, 8, 0) if asked for."""

    @F.pandas_udf("binary")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else (bytes([1, 4, 8, 0]) if header else b"") + np.asarray(v, "<f4").tobytes())

    return encode(histogram)


def sobel_histogram(blob: Column, header: bool = False) -> Column:
    """The histogram of a blob; null where its header or length is wrong."""

    @F.pandas_udf("array<float>")
    def decode(column: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None or (header and raw[:4] != bytes([1, 4, 8, 0])):
                return None
            body = raw[4:] if header else raw
            return np.frombuffer(body, "<f4") if len(body) % 4 == 0 else None

        return column.map(one)

    return decode(blob)
