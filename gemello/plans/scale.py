"""Synthetic workloads of the published baseline: band index with Hamming filter, and media kernels over drawn pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemello.functions import media
from gemello.functions.hashing import hamming
from gemello.operators import cluster, joins


def band_corpus(spark: SparkSession, rows: int, copies: int = 4) -> DataFrame:
    """`rows` random 256-bit hashes as four 64-bit bands; a tenth of them in clusters whose members differ in one bit of band 0."""
    own = F.when(F.col("id") % 10 == 0, F.col("id") - F.col("id") % (10 * copies)).otherwise(F.col("id"))
    bands = [F.xxhash64(F.lit(i), own) for i in range(4)]
    flip = F.expr(f"if(id % 10 = 0, shiftleft(1L, cast(id % {10 * copies} div 10 as int)), 0L)")
    return spark.range(rows).select(F.col("id").alias("image_id"), F.array(bands[0].bitwiseXOR(flip), *bands[1:]).alias("bands"))


def band_index(spark: SparkSession, rows: int) -> DataFrame:
    corpus = band_corpus(spark, rows)
    pairs = joins.with_sides(joins.band_join(corpus, "image_id", "bands"), corpus, "image_id", ["bands"])
    return pairs.withColumn("distance", hamming(F.col("l_bands"), F.col("r_bands"))).where("distance <= 31").select("left", "right", "distance")


def _drawn(spark: SparkSession, n: int) -> DataFrame:
    """n grey images of 48 x 40 pixels: gradients and stripes that depend on their number."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(48 * 40 - 1)), lambda i: F.lpad(F.hex((i % 48 * (F.col("id") % 5 + 1) + F.floor(i / 48) * (F.col("id") % 7) + i % (F.col("id") % 11 + 2) * 9) % 256), 2, "0"))
    return spark.range(n).select(F.col("id").alias("image_id"), F.unhex(F.array_join(pixels, "")).alias("pixels"), F.lit(48).alias("width"), F.lit(40).alias("height"))


def kernels(spark: SparkSession, n: int) -> DataFrame:
    f = _drawn(spark, n).select("image_id", media.features(F.col("pixels"), F.col("width"), F.col("height")).alias("f"))
    return f.select("image_id", F.lower(F.hex("f.pdq")).alias("pdq"), "f.quality", F.array_join(F.transform("f.parts", lambda x: x.cast("string")), ",").alias("parts"), F.round(F.aggregate("f.histogram", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm"))


CATALOG = {
    "scale_band_index_100k": (
        lambda s, d: band_index(s, 100_000),
        """WITH c AS (SELECT range AS id, range - range % 40 AS head FROM range(100000) WHERE range % 10 = 0)
        SELECT a.id AS "left", b.id AS "right", 2 AS distance FROM c a JOIN c b ON a.head = b.head AND a.id < b.id""",
    ),
    "scale_band_groups_100k": (
        lambda s, d: cluster.connected_components(band_index(s, 100_000)),
        "SELECT range AS node, range - range % 40 AS component FROM range(100000) WHERE range % 10 = 0",
    ),
    "v01_media_kernels": (lambda s, d: kernels(s, 200), None),
}
