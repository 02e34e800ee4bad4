"""Joins that Spark has no operator for, as equi-joins that it can plan well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemello.functions.hashing import hamming
from gemello.operators import cluster


def band_join(features: DataFrame, key: str, bands: str, slot: str | None = None) -> DataFrame:
    """Distinct pairs (left, right), left < right, of rows that agree in at least one band (and slot).

    Bands are exploded and joined on place and value, never by an OR of equalities, which would compare all rows; AQE
    splits hot buckets. Filter rows (quality) before, as a degenerate hash fills one bucket.
    """
    extra = [F.col(slot).alias("slot")] if slot else []
    rows = features.select(F.col(key).alias("k"), *extra, F.posexplode(bands).alias("band", "value"))
    on = ["band", "value", *(["slot"] if slot else [])]
    pairs = rows.withColumnRenamed("k", "left").join(rows.withColumnRenamed("k", "right"), on).where("left < right")
    return pairs.select("left", "right").distinct()


def with_sides(pairs: DataFrame, features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """pairs with the columns of both sides, as l_<name> and r_<name>."""
    out = pairs
    for side, prefix in (("left", "l_"), ("right", "r_")):
        own = features.select(F.col(key).alias(f"{prefix}key"), *[F.col(c).alias(prefix + c) for c in columns])
        out = out.join(own, F.col(side) == F.col(f"{prefix}key")).drop(f"{prefix}key")
    return out


def range_join(rows: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """Pairs (left, right), left < right, whose values differ by at most `width`, inclusive.

    Values fall into buckets as wide as the window, rounded down also below 0; each row meets its own and the next
    bucket in an equi-join, so every pair is found once. Differences are taken as decimals, which extreme values don't overflow.
    """
    step = max(width, 1)
    rows = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("decimal(20,0)").alias("v"))
    bucket = F.floor(F.col("v") / step)
    a = rows.select(F.col("k").alias("ka"), F.col("v").alias("va"), bucket.alias("own"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = rows.select(F.col("k").alias("kb"), F.col("v").alias("vb"), bucket.alias("bucket"))
    near = a.join(b, "bucket").where(F.abs(F.col("va") - F.col("vb")) <= width)
    # in the same bucket both directions meet: one is kept; across buckets only the lower one reaches up
    once = near.where((F.col("bucket") != F.col("own")) | (F.col("ka") < F.col("kb")))
    return once.select(F.least("ka", "kb").alias("left"), F.greatest("ka", "kb").alias("right")).where("left < right")


def in_order(asked: DataFrame, keys: str, known: DataFrame, key: str) -> DataFrame:
    """A left join from an array of keys that keeps its order (as `pos`) and its repeats."""
    return asked.select(F.posexplode(keys).alias("pos", "asked")).join(known, F.col("asked") == F.col(key), "left")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `pos`, their place in the order of key from 0: ranges are sorted apart, and only the ranges' sizes come together."""
    parts = cluster.written(rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), cluster.shared_dir(rows))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return parts.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("pos", F.col("before") + F.col("__own")).drop("__part", "__own", "before")


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str, key: str) -> DataFrame:
    """Each path with the deepest root that holds it: paths explode to their ancestors, which meet the roots in an equi-join."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = paths.select(key, path, F.explode(ancestors).alias("ancestor"))
    hit = up.join(roots.select(F.col(root).alias("ancestor")).distinct(), "ancestor")
    return hit.groupBy(key, path).agg(F.max_by("ancestor", F.length("ancestor")).alias("root"))


def stale(active: DataFrame, seen: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Active rows that weren't seen under any of the roots: an anti-join, then a semi-join on ancestors."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    unseen = active.join(seen.select(path), path, "left_anti")
    under = unseen.select(path, F.explode(ancestors).alias("root")).join(roots.select("root"), "root", "left_semi").select(path).distinct()
    return unseen.join(under, path, "left_semi")


def screened_images(images: DataFrame, bands: str = "bands", most: int = 31, quality: int = 50, tolerance: float = 0.1) -> DataFrame:
    """Stage-1 image candidates: both good enough, a band in common, near aspect, Hamming distance up to `most`."""
    from gemello.functions.hashing import close_aspect

    good = images.where(F.col("quality") >= quality)
    pairs = with_sides(band_join(good, "image_id", bands), good, "image_id", [bands, "width", "height", "quality"])
    pairs = pairs.where(close_aspect(F.col("l_width"), F.col("l_height"), F.col("r_width"), F.col("r_height"), tolerance))
    distance = hamming(F.col(f"l_{bands}"), F.col(f"r_{bands}"))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= most).select("left", "right", "distance", "l_quality", "r_quality")


def screened_videos(videos: DataFrame, window_ms: int = 2000, most: int = 31, bands: str = "bands") -> DataFrame:
    """Stage-1 video candidates of the first profile: near durations and thumbnails, without a band or quality gate."""
    pairs = with_sides(range_join(videos, "image_id", "duration_ms", window_ms), videos, "image_id", [bands, "duration_ms"])
    return pairs.withColumn("distance", hamming(F.col(f"l_{bands}"), F.col(f"r_{bands}"))).where(F.col("distance") <= most).select("left", "right", "distance")


def best_copy(copies: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first copy of each content in an order."""
    return copies.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rank = 1").drop("rank")
