import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gemello.functions import hashing, media, paths


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "path, want",
    [
        (r"C:\Media\Album\..\Song.mp3", r"C:\MEDIA\SONG.MP3"),
        ("c:/a//b/./c/", r"C:\A\B\C"),
        ("c:/", "C:\\"),
        (r"\\?\d:\x", r"D:\X"),
        (r"\\?\UNC\srv\share\a\..", "\\\\SRV\\SHARE\\"),
        (r"\\srv\share\a", r"\\SRV\SHARE\A"),
        (r"C:\a\..\..\b", None),
        ("relative/path", None),
        ("C:x", None),
        (r"\\srv", None),
        (None, None),
    ],
)
def test_normalized(spark, path, want):
    assert one(spark, "p string", (path,), paths.normalized(F.col("p"))) == want


@pytest.mark.parametrize("path, root, want", [("C:\\MEDIA2\\X", "C:\\MEDIA\\", False), ("C:\\MEDIA\\X", "C:\\MEDIA\\", True), ("C:\\MEDIA", "C:\\MEDIA\\", True), ("D:\\A", "D:\\", True)])
def test_is_within(spark, path, root, want):
    assert one(spark, "p string, r string", (path, root), paths.is_within(F.col("p"), F.col("r"))) is want


def test_names_and_kinds(spark):
    rows = [("a/b\\C.JPG", "C.JPG", ".JPG", "image"), ("x.tar.gz", "x.tar.gz", ".gz", "other"), ("v/clip.m2ts", "clip.m2ts", ".m2ts", "video"), ("none", "none", "", "other"), ("d.x/none", "none", "", "other")]
    df = spark.createDataFrame(rows, "p string, b string, e string, k string")
    p = F.col("p")
    assert df.where((paths.basename(p) == F.col("b")) & (paths.extension(p) == F.col("e")) & (paths.media_kind(p) == F.col("k"))).count() == len(rows)
    assert one(spark, "p string", ("a%B_c",), paths.contains_text(F.col("p"), "%b_")) is True
    assert one(spark, "p string", ("a\tb\rc\nd\0e",), paths.tsv(F.col("p"))) == "a\\x09b\\x0dc\\x0ad\\x00e"


def test_hamming_and_bands(spark):
    a, b = bytes(32), bytes([0b111]) + bytes(31)
    df = spark.createDataFrame([(a, b)], "a binary, b binary")
    r = df.select(hashing.hamming(hashing.words_of(F.col("a")), hashing.words_of(F.col("b"))).alias("d"), hashing.shares_band(hashing.bands_of(F.col("a")), hashing.bands_of(F.col("b"))).alias("s")).first()
    assert (r.d, r.s) == (3, True)
    full = spark.createDataFrame([(a, b"\xff" * 32)], "a binary, b binary")
    assert full.select(hashing.hamming(hashing.words_of(F.col("a")), hashing.words_of(F.col("b"))).alias("d")).first().d == 256


@pytest.mark.parametrize("a, b, g, r", [([0.0, 0.0], [0.0, 0.0], 1.0, 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0, 0.0), ([1.0, 0.0], [1.0, 0.0], 1.0, 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0, -1.0), ([math.nan, 1.0], [1.0, 1.0], 0.0, None), ([3.0, 4.0], [4.0, 3.0], 0.96, 0.96)])
def test_cosines(spark, a, b, g, r):
    df = "a array<double>, b array<double>"
    assert one(spark, df, (a, b), hashing.cosine(F.col("a"), F.col("b"))) == pytest.approx(g)
    if r is not None:
        assert one(spark, df, (a, b), hashing.cosine_r(F.col("a"), F.col("b"))) == pytest.approx(r, abs=1e-6)
    assert one(spark, df, (a, b), hashing.finite(F.col("a"))) is not any(map(math.isnan, a))


@pytest.mark.parametrize("sizes, want", [((1920, 1080, 1440, 1080), False), ((1000, 1000, 1000, 900), True), ((1000, 1000, 1000, 899), False), ((None, 5, 3, 4), True), ((0, 5, 3, 4), True)])
def test_aspect(spark, sizes, want):
    assert one(spark, "a int, b int, c int, d int", sizes, hashing.close_aspect(*map(F.col, "abcd"), 0.1)) is want


def test_blobs(spark):
    parts = [1, -1, 1 << 62, 0, 255, 256, -(1 << 63), 3, 7]
    want = b"".join(int(p).to_bytes(8, "little", signed=True) for p in parts)
    df = spark.createDataFrame([(parts,)], "p array<bigint>")
    assert bytes(df.select(hashing.phash_blob(F.col("p")).alias("b")).first().b) == want
    assert bytes(df.select(hashing.phash_blob(F.col("p"), header=True).alias("b")).first().b) == bytes([1, 3, 3, 0]) + want
    back = df.select(hashing.phash_parts(hashing.phash_blob(F.col("p"), True), True).alias("w")).first().w
    assert [lo | hi << 32 for lo, hi in zip(back[::2], back[1::2])] == [p % (1 << 64) for p in parts]


def test_masks_midpoints_digests(spark):
    assert one(spark, "d long", (12_001,), hashing.midpoints(F.col("d"))) == [12_001 * (2 * i + 1) // 12 for i in range(6)]
    states = [one(spark, "m int, r int, f boolean", row, hashing.stage_state(F.col("m"), F.col("r"), F.col("f"))) for row in [(0, 3, False), (1, 3, False), (3, 3, True), (3, 3, False), (8, 3, False)]]
    assert states == ["done", "partial", "failed", "pending", "done"]
    assert [one(spark, "h string", (h,), hashing.is_digest(F.col("h"))) for h in ("a" * 128, "A" * 128, "a" * 127, None)] == [True, False, False, False]
    assert one(spark, "a int, b string", (None, "x"), hashing.missing_mask([(F.col("a"), 1), (F.col("b"), 2)])) == 1


def pdq_by_loops(image):
    """The hash by its definition, with plain sliding sums."""
    rows, columns = image.shape
    a = image.astype(float)

    def box(v, w):
        half = (w + 2) // 2
        return [np.mean(v[max(0, i + half - w) : min(len(v), i + half)]) for i in range(len(v))]

    if (rows, columns) != (64, 64):
        for _ in range(2):
            a = np.array([box(r, -(-columns // 128)) for r in a])
            a = np.array([box(c, -(-rows // 128)) for c in a.T]).T
        a = np.array([[a[int((y + 0.5) * rows / 64), int((x + 0.5) * columns / 64)] for x in range(64)] for y in range(64)])
    m = np.array([[math.sqrt(2 / 64) * math.cos(math.pi / 128 * (k + 1) * (2 * n + 1)) for n in range(64)] for k in range(16)])
    c = (m @ a @ m.T).reshape(-1)
    middle = sorted(c)[127]
    bits = [int(v > middle) for v in c]
    return int("".join(map(str, reversed(bits))), 2).to_bytes(32, "big")


@pytest.mark.parametrize("shape", [(64, 64), (200, 150), (40, 300)])
def test_pdq(shape):
    image = np.random.default_rng(5).integers(0, 256, shape).astype(np.uint8)
    got, quality = media.pdq(image)
    want = pdq_by_loops(image)
    assert bin(int.from_bytes(got) ^ int.from_bytes(want)).count("1") <= 2 and 0 <= quality <= 100
    assert media.pdq(np.zeros((4, 90), np.uint8)) == (bytes(32), 0)
    flat, quality = media.pdq(np.full((80, 80), 9, np.uint8))
    assert quality == 0


def test_kernels(spark):
    image = np.tile(np.arange(96, dtype=np.uint8) * 2, (96, 1))
    parts = media.partition_hashes(image)
    assert len(parts) == 9 and all(-(1 << 63) <= p < 1 << 63 for p in parts)
    h = media.gradients(image)
    assert len(h) == 128 and sum(x * x for x in h) == pytest.approx(1, abs=1e-5) and all(x == 0 for i, x in enumerate(h) if i % 8)
    assert media.gradients(np.zeros((8, 8), np.uint8)) == [0.0] * 128
    assert media.gray(np.array([[[255, 255, 255], [0, 0, 0], [10, 20, 30]]], np.uint8)).tolist() == [[255, 0, 18]]
    assert media.resized(np.array([[0, 100]], np.uint8), 4, 1).tolist() == [[0, 25, 75, 100]]
    df = spark.createDataFrame([(image.tobytes(), 96, 96), (b"xx", 96, 96), (None, 1, 1), (b"", 0, 0)], "p binary, w int, h int")
    rows = df.select(media.features(F.col("p"), F.col("w"), F.col("h")).alias("f")).collect()
    assert rows[0].f.parts == parts and [r.f.pdq for r in rows[1:]] == [None] * 3
