"""File walks: folders read as inventories, with digests that are computed where the files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemello.functions.paths import extension, media_kind


def walk(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, digests: bool = False) -> DataFrame:
    """path, size, mtime_ms and kind of all files under the roots, each path once whatever roots overlap.

    Extensions (with their full stop, any case) filter the rows. With digests, md5, sha256 and sha512 of the contents
    come too; without them the contents aren't read, as only the listing's columns are asked for. Spark's readers leave
    empty files out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    if extensions:
        files = files.where(F.lower(extension(F.col("path"))).isin([e.lower() for e in extensions]))
    columns = [F.col("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), media_kind(F.col("path")).alias("kind")]
    if digests:
        columns += [F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512")]
    return files.select(*columns).dropDuplicates(["path"])
