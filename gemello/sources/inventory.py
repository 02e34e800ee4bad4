"""Sources: file inventories, features, groups and change logs, derived from the driver's tables.

Each derivation stands twice: as a DataFrame, and as a common table expression (`WITH`) for the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".jpg", ".MP4", ".PNG", ".mkv", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file inventory: documents are files, sources machines, labels say what is deleted or reviewed."""
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.join(la, F.col("doc_id") == F.col("l_id"), "left").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("machine_id"),
        F.concat(F.lit("C:/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.col("n_chars").alias("size"),
        (F.col("doc_id") * 7919 % 100003).alias("mtime"),
        (F.col("doc_id") % 3).alias("disk_no"),
        F.md5("text").alias("content"),
        F.when(F.col("toxic") == 1, "deleted").otherwise("active").alias("status"),
        F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "delete").otherwise("undecided").alias("review"),
        (F.col("doc_id") * 37 % 101).alias("quality"),
    )


FILES = """files AS (
    SELECT d.doc_id AS file_id, d.source AS machine_id,
           'C:/' || d.lang || '/' || d.source || '/' || d.doc_id || (CASE d.doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.MP4' WHEN 2 THEN '.PNG' WHEN 3 THEN '.mkv' ELSE '.txt' END) AS path,
           d.n_chars AS size, d.doc_id * 7919 % 100003 AS mtime, d.doc_id % 3 AS disk_no, md5(d.text) AS content,
           CASE WHEN l.toxic = 1 THEN 'deleted' ELSE 'active' END AS status,
           CASE WHEN l.quality = 1 THEN 'keep' WHEN l.quality = 0 THEN 'delete' ELSE 'undecided' END AS review,
           d.doc_id * 37 % 101 AS quality
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def groups(files_: DataFrame) -> DataFrame:
    """Stored groups of equal content: group_id, kind and rep_id, the smallest id (even if deleted since)."""
    return files_.groupBy(F.col("content").alias("group_id")).agg(F.min("file_id").alias("rep_id"), F.count(F.lit(1)).alias("n_stored")).where("n_stored > 1").withColumn("kind", F.lit("exact"))


def members(files_: DataFrame) -> DataFrame:
    """Live members of stored groups with their files' columns."""
    g = groups(files_).select("group_id", "rep_id", "kind")
    return g.join(files_.where(F.col("status") != "deleted"), F.col("group_id") == F.col("content")).drop("content", "status")


MEMBERS = (
    FILES
    + """, groups AS (
    SELECT content AS group_id, min(file_id) AS rep_id, 'exact' AS kind FROM files GROUP BY content HAVING count(*) > 1),
members AS (
    SELECT g.*, f.file_id, f.machine_id, f.path, f.size, f.mtime, f.disk_no, f.review, f.quality
    FROM groups g JOIN files f ON f.content = g.group_id WHERE f.status <> 'deleted')"""
)


def _bands(n: int, width: int) -> list:
    return [F.expr(f"aggregate(sequence(0, {width - 1}), 0, (a, j) -> a + if(embedding[{width * i} + j] > 0, shiftleft(1, j), 0))") for i in range(n)]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image features: embeddings' signs are 64-bit hashes, as four bands of 16 bits and eight of 8 bits."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("image_id"),
        "embedding",
        F.array(*_bands(4, 16)).alias("bands"),
        F.array(*_bands(8, 8)).alias("bands8"),
        (F.col("vec_id") * 37 % 101).alias("quality"),
        (F.col("vec_id") * 53 % 7 * 160 + 640).alias("width"),
        (F.col("vec_id") * 29 % 5 * 120 + 480).alias("height"),
        (F.col("vec_id") * 977 % 60000).alias("duration_ms"),
    )


IMAGES = """images AS (
    SELECT vec_id AS image_id, embedding,
           list_transform(range(4), lambda i: CAST(list_sum(list_transform(range(16), lambda j: CASE WHEN embedding[16 * i + j + 1] > 0 THEN 1 << j ELSE 0 END)) AS INTEGER)) AS bands,
           list_transform(range(8), lambda i: CAST(list_sum(list_transform(range(8), lambda j: CASE WHEN embedding[8 * i + j + 1] > 0 THEN 1 << j ELSE 0 END)) AS INTEGER)) AS bands8,
           vec_id * 37 % 101 AS quality, vec_id * 53 % 7 * 160 + 640 AS width, vec_id * 29 % 5 * 120 + 480 AS height,
           vec_id * 977 % 60000 AS duration_ms
    FROM embeddings)"""
#: Hamming distance of a and b in SQL.
HAMMING_SQL = "CAST(list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a.bands8[i], b.bands8[i])))) AS INTEGER)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video frames: the first six turns of a conversation are slots, their text's digest the hash of four 16-bit bands."""
    c = table(spark, sf_dir, "conversations").where("turn < 6")
    h = F.md5("text")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("slot"), F.array(*[F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int") for i in range(4)]).alias("bands"), F.length("text").alias("n"))


FRAMES = """frames AS (
    SELECT conv_id AS video_id, turn AS slot,
           list_transform(range(4), lambda i: CAST('0x' || substr(md5(text), 4 * i + 1, 4) AS INTEGER)) AS bands, length(text) AS n
    FROM conversations WHERE turn < 6)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log: events in order of seq, about an entity, of a kind, with a value and a payload."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), "value", "props", F.col("ts").cast("timestamp").alias("ts"))


CHANGES = "changes AS (SELECT event_id AS seq, user_id AS entity, event_type AS kind, value, props, ts FROM events)"
