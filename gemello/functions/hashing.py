"""Scalar functions over hashes, vectors and masks, as columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """The number of different bits of two hashes given as equally long arrays of integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def words_of(hash_: Column, size: int = 32) -> Column:
    """A binary hash as an array of 32-bit words, which fit a signed 64-bit number."""
    return F.array(*[F.conv(F.hex(F.substring(hash_, 1 + 4 * i, 4)), 16, 10).cast("long") for i in range(size // 4)])


def bands_of(hash_: Column, size: int = 32, width: int = 8) -> Column:
    """A binary hash as bands of `width` bytes; they are only compared for equality, so they stay binary."""
    return F.array(*[F.substring(hash_, 1 + width * i, width) for i in range(size // width)])


def shares_band(a: Column, b: Column) -> Column:
    """Whether two arrays of bands agree in some place."""
    return F.exists(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)


def dot(a: Column, b: Column) -> Column:
    """The sum of products in order of index, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the first profile: both norms exactly 0 give 1, one gives 0, what isn't finite 0, and it stays in -1 to 1."""
    na, nb = dot(a, a), dot(b, b)
    raw = F.try_divide(dot(a, b), F.sqrt(na) * F.sqrt(nb))
    known = F.when(raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf")), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(known)


def cosine_r(a: Column, b: Column) -> Column:
    """Cosine of the second profile: norms up to 1e-9 count as 0, the result is a float and not clamped."""
    na, nb = dot(a, a), dot(b, b)
    za, zb = F.sqrt(na) <= 1e-9, F.sqrt(nb) <= 1e-9
    return F.when(za & zb, 1.0).when(za | zb, 0.0).otherwise(F.try_divide(dot(a, b), F.sqrt(na * nb))).cast("float")


def close_aspect(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float) -> Column:
    """First profile: cross products differ by at most `tolerance` of the larger; unknown dimensions pass."""
    x, y = w1.cast("double") * h2, w2.cast("double") * h1
    limit = F.greatest(x, y) * tolerance
    known = (w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0)
    return F.when(F.coalesce(known, F.lit(False)), F.abs(x - y) <= limit * (1 + 2.0**-52)).otherwise(True)


def close_aspect_r(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float) -> Column:
    """Second profile: single-precision ratios differ by at most `tolerance` of the larger."""
    a, b = (w1.cast("float") / h1.cast("float")).cast("float"), (w2.cast("float") / h2.cast("float")).cast("float")
    return ((F.abs(a - b).cast("float") / F.greatest(a, b)).cast("float")) <= F.lit(tolerance).cast("float")


def missing_mask(fields: list[tuple[Column, int]]) -> Column:
    """The bits of the fields that are null."""
    mask = F.lit(0)
    for value, bit in fields:
        mask = mask + F.when(value.isNull(), bit).otherwise(0)
    return mask


def stage_state(missing: Column, required: Column, failed: Column) -> Column:
    """done, partial, failed or pending by the required fields that are missing."""
    left = missing.bitwiseAND(required)
    return F.when(left == 0, "done").when(left != required, "partial").when(failed, "failed").otherwise("pending")


def is_digest(value: Column, digits: int = 128) -> Column:
    """A lower-case hexadecimal digest of so many digits."""
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


def phash_blob(parts: Column, header: bool = False) -> Column:
    """Nine 64-bit parts as little-endian bytes, with the first profile's header (1, 3, 3, 0) if asked for."""
    hexed = F.concat(*[_little_endian(F.lpad(F.hex(parts[i]), 16, "0")) for i in range(9)])
    return F.unhex(F.concat(F.lit("01030300"), hexed) if header else hexed)


def _little_endian(hexed: Column) -> Column:
    return F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in range(7, -1, -1)])


def phash_parts(blob: Column, header: bool = False) -> Column:
    """The parts as pairs of 32-bit words (low, high), which compare and count bits like the 64-bit numbers."""
    skip = 4 if header else 0

    def word(at: int) -> Column:
        h = F.hex(F.substring(blob, 1 + skip + at, 4))
        return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(3, -1, -1)]), 16, 10).cast("long")

    return F.array(*[word(4 * i) for i in range(18)])


def midpoints(duration_ms: Column, n: int = 6) -> Column:
    """The middle of each of n equal parts, in whole milliseconds."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(duration_ms * (2 * i + 1) / (2 * n)))


def decoded_digest(value: Column, digits: int = 64) -> Column:
    """The bytes of a lower-case hexadecimal digest; null where it isn't one."""
    return F.when(is_digest(value, digits), F.unhex(value))


def big_endian_bands(hash_: Column, size: int = 32) -> Column:
    """A binary hash as big-endian 64-bit numbers, signed as Spark's are."""
    return F.array(*[F.conv(F.hex(F.substring(hash_, 1 + 8 * i, 8)), 16, -10).cast("long") for i in range(size // 8)])


def xorshift64(state: Column) -> Column:
    """The next state of the 64-bit generator with shifts 13, 7 and 17."""
    x = state.bitwiseXOR(F.shiftleft(state, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def next_limit(current: Column, hard: Column, bps: Column, before_bps: Column, p95: Column, before_p95: Column, enough: Column, all_busy: Column, queued: Column) -> Column:
    """The next limit of concurrent reads of a disk.

    Without enough of a sample it stays; a drop of more than 8 % in throughput or a doubled wait takes a quarter off (one
    at least, down to 1); a gain of 5 % or waiting work adds one, unless all workers are busy or the limit is reached.
    """
    now = F.least(F.greatest(current, F.lit(1)), F.greatest(hard, F.lit(1)))
    change = F.when(before_bps > 0, (bps - before_bps) / before_bps)
    worse = F.coalesce(change < -0.08, F.lit(False)) | ((before_p95 > 0) & (p95 > 2 * before_p95))
    better = F.coalesce(change >= 0.05, F.lit(False)) | (queued > 0)
    less = F.greatest(now - F.greatest(F.floor(now / 4), F.lit(1)), F.lit(1))
    return F.when(~enough, now).when(worse, less).when(all_busy | (now >= hard), now).when(better, now + 1).otherwise(now).cast("long")
