"""Queries of joint video judging, recovered pairs, applied results, blobs and bands, roots, limits, sinks and pulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from gemello.functions import hashing, media, paths
from gemello.operators import cluster, groups, scoring
from gemello.operators.config import Thresholds
from gemello.plans.candidates import _COS_SQL
from gemello.sources.inventory import CHANGES, FILES, IMAGES, MEMBERS, changes, files, images, members
from gemello.streaming import sync

#: Images as frames: six in a row are a video's slots; every seventh lacks its histogram.
_T = Thresholds(part_bits=3, parts=3, sobel=0.1, video_mean=0.03, video_frames=4)
_T_R = Thresholds(part_bits=3, parts=3, sobel=0.1, video_mean=0.03, video_frames=4, count_rule=False)


def _video_slots(s, d):
    f = images(s, d).select(
        F.expr("image_id div 6").alias("video_id"),
        F.expr("image_id % 6").alias("slot"),
        F.col("bands8").alias("parts"),
        F.when(F.col("image_id") % 49 != 0, F.col("embedding")).alias("hist"),
        (F.col("image_id") % 11 != 0).alias("valid"),
    )
    videos = f.select("video_id").distinct()
    pairs = videos.select(F.col("video_id").alias("left"), F.explode(F.array(F.col("video_id") + 1, F.col("video_id") + 2)).alias("right"))
    return scoring.slot_pairs(pairs, f, "video_id", ["parts", "hist", "valid"]).withColumn("valid", F.col("l_valid") & F.col("r_valid"))


_VIDEO_SQL = (
    IMAGES
    + f""", slots AS (
    SELECT a.image_id // 6 AS "left", b.image_id // 6 AS "right", a.image_id % 6 AS slot, a.image_id % 11 <> 0 AND b.image_id % 11 <> 0 AS valid,
           a.image_id % 49 = 0 OR b.image_id % 49 = 0 AS lacks,
           len(list_filter(range(1, 9), lambda i: bit_count(xor(a.bands8[i], b.bands8[i])) <= 3)) >= 3 AS near,
           CASE WHEN a.image_id % 49 = 0 OR b.image_id % 49 = 0 THEN 0 ELSE {_COS_SQL} END AS c
    FROM images a JOIN images b ON a.image_id % 6 = b.image_id % 6 AND b.image_id // 6 - a.image_id // 6 IN (1, 2))"""
)


def _bulk_loaded(s, d):
    """Members written in one bulk load, a folder for each kind, and read back."""
    where = cluster.shared_folder(s)
    members(files(s, d)).select("kind", "group_id", "file_id", "machine_id").write.partitionBy("kind").parquet(where)
    return s.read.parquet(where).select("kind", "group_id", "file_id", "machine_id")


def _telemetry(s, d):
    """Samples written as JSON lines and read back with a stated schema."""
    where = cluster.shared_folder(s)
    rows = changes(s, d).select("seq", "entity", "kind", "value")
    rows.write.json(where)
    return s.read.schema(rows.schema).json(where)


def _applied(s, d):
    f, m = files(s, d), members(files(s, d))
    results = m.where("review = 'delete'").select("file_id", (F.col("file_id") % 5 != 0).alias("ok"))
    return f, *groups.applied_results(f, m, results)


def _consumers(s, d):
    log = changes(s, d).select(F.col("entity").alias("consumer"), "seq")
    cursors = log.groupBy("consumer").agg(F.min("seq").alias("cursor"))
    return sync.pulled(cursors, log, 40, 10)


def _limits(s, d):
    f = files(s, d)
    return f.select(
        "file_id",
        hashing.next_limit(
            F.col("disk_no") * 4, F.lit(7), F.col("size").cast("double"), F.col("mtime").cast("double") / 20, F.col("quality").cast("double"), F.col("disk_no").cast("double") * 40,
            F.col("size") > 50, F.col("quality") % 5 == 0, F.col("disk_no"),
        ).alias("next"),
    )


_ROOTS = ("C:\\Data\\Photos", "c:/data/../x", "C:\\", "relative\\x", "D:/a//b/", "\\\\nas\\share\\dir")

CATALOG = {
    "c06_video_joint": (
        lambda s, d: scoring.video_joint(_video_slots(s, d), _T).select("left", "right", F.col("n_valid").cast("long").alias("n_valid"), F.col("n_passed").cast("long").alias("n_passed"), F.round("mean", 6).alias("mean"), "verdict"),
        f"""WITH {_VIDEO_SQL}, j AS (
            SELECT "left", "right", CAST(sum(valid::INT) AS BIGINT) AS n_valid, CAST(sum((valid AND near AND c >= 0.1)::INT) AS BIGINT) AS n_passed, sum(CASE WHEN valid AND near THEN c ELSE 0 END) AS total FROM slots GROUP BY 1, 2)
        SELECT "left", "right", n_valid, n_passed, CASE WHEN n_valid >= 4 THEN round(total / n_valid, 6) END AS mean,
               CASE WHEN n_valid < 4 THEN 'inconclusive' WHEN total / n_valid >= 0.03 OR n_passed >= 4 THEN 'yes' ELSE 'no' END AS verdict FROM j""",
    ),
    "c08_video_stage2": (
        lambda s, d: scoring.video_stage2_r(_video_slots(s, d), _T_R).select("left", "right", F.col("n_valid").cast("long").alias("n_valid"), "verdict"),
        f"""WITH {_VIDEO_SQL}, j AS (
            SELECT "left", "right", CAST(sum(valid::INT) AS BIGINT) AS n_valid, bool_or(valid AND lacks) AS lacks, sum(CASE WHEN valid AND near THEN c ELSE 0 END) AS total FROM slots GROUP BY 1, 2)
        SELECT "left", "right", n_valid, CASE WHEN n_valid < 4 OR lacks THEN 'incomplete' WHEN total / n_valid >= 0.03 THEN 'passed' ELSE 'rejected' END AS verdict FROM j""",
    ),
    "c28_applied_statuses": (
        lambda s, d: _applied(s, d)[1].select("file_id", "status"),
        f"""WITH {MEMBERS}, done AS (SELECT file_id FROM members WHERE review = 'delete' AND file_id % 5 <> 0)
        SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM done) THEN 'deleted' ELSE status END AS status FROM files""",
    ),
    "c28_shrunk_groups": (
        lambda s, d: _applied(s, d)[2].select("group_id", "n_left", F.col("released").cast("long").alias("released"), "dissolved"),
        f"""WITH {MEMBERS}, m AS (SELECT *, review = 'delete' AND file_id % 5 <> 0 AS gone FROM members)
        SELECT group_id, count(*) FILTER (NOT gone) AS n_left, CAST(coalesce(sum(size) FILTER (gone), 0) AS BIGINT) AS released, count(*) FILTER (NOT gone) < 2 AS dissolved FROM m GROUP BY 1""",
    ),
    "f03_bands": (
        lambda s, d: files(s, d).select("file_id", F.array_join(hashing.big_endian_bands(F.unhex(F.sha2("content", 256))), ",").alias("bands")),
        f"""WITH {FILES}, h AS (SELECT file_id, sha256(content) AS h FROM files), b AS (
            SELECT file_id, list_transform(range(4), lambda i: CAST('0x' || substr(h, 16 * i + 1, 16) AS UBIGINT)::HUGEINT) AS u FROM h)
        SELECT file_id, array_to_string(list_transform(u, lambda x: CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END), ',') AS bands FROM b""",
    ),
    "f08_sobel_blobs": (
        lambda s, d: images(s, d).select("image_id", "embedding", media.sobel_blob(F.col("embedding"), True).alias("blob")).select(
            "image_id", F.length("blob").alias("n_bytes"), F.forall(F.zip_with(media.sobel_histogram(F.col("blob"), True), "embedding", lambda x, y: x == y.cast("float")), lambda e: e).alias("same"), media.sobel_histogram(F.expr("substring(blob, 2)"), True).isNull().alias("refused")),
        f"WITH {IMAGES} SELECT image_id, CAST(4 + 4 * len(embedding) AS INTEGER) AS n_bytes, TRUE AS same, TRUE AS refused FROM images",
    ),
    "f09_decoded_digests": (
        lambda s, d: files(s, d).select("file_id", F.when(F.col("file_id") % 3 == 0, F.upper("content")).otherwise(F.col("content")).alias("h")).select("file_id", F.octet_length(hashing.decoded_digest(F.col("h"), 32)).alias("n_bytes")),
        f"WITH {FILES} SELECT file_id, CASE WHEN file_id % 3 = 0 AND upper(content) <> content THEN NULL ELSE 16 END AS n_bytes FROM files",
    ),
    "f14_task_roots": (
        lambda s, d: s.createDataFrame([(p,) for p in _ROOTS], "path string").select("path", paths.task_root(F.col("path")).alias("root")),
        f"""SELECT * FROM (VALUES {', '.join(f"('{p}', {r})" for p, r in zip(_ROOTS, ("'c:" + chr(92) + "data" + chr(92) + "photos'", "NULL", "NULL", "NULL", "'d:" + chr(92) + "a" + chr(92) + "b'", "'" + chr(92) * 2 + "nas" + chr(92) + "share" + chr(92) + "dir'")))}) AS t(path, root)""",
    ),
    "f20_epochs": (
        lambda s, d: files(s, d).select("file_id", F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm:ss").alias("at")),
        f"WITH {FILES} SELECT file_id, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM files",
    ),
    "f29_xorshift": (
        lambda s, d: images(s, d).select("image_id", F.hex(hashing.xorshift64(hashing.xorshift64(F.col("image_id") * 1000003 + 1))).alias("state")),
        f"""WITH {IMAGES}, m AS (SELECT 18446744073709551616::HUGEINT AS m), s AS (SELECT image_id, (image_id * 1000003 + 1)::HUGEINT AS x, m FROM images, m),
        {', '.join(f"s{i}a AS (SELECT image_id, m, xor(x, (x * 8192) % m) AS x FROM {p}), s{i}b AS (SELECT image_id, m, xor(x, x // 128) AS x FROM s{i}a), s{i} AS (SELECT image_id, m, xor(x, (x * 131072) % m) AS x FROM s{i}b)" for i, p in ((1, 's'), (2, 's1')))}
        SELECT image_id, upper(to_hex(x::UBIGINT)) AS state FROM s2""",
    ),
    "f31_next_limits": (
        _limits,
        f"""WITH {FILES}, s AS (SELECT file_id, least(greatest(disk_no * 4, 1), 7) AS now, size > 50 AS enough, quality % 5 = 0 AS busy, disk_no AS queued,
            CASE WHEN mtime > 0 THEN (size - mtime / 20) / (mtime / 20) END AS change, disk_no > 0 AND quality > 80 * disk_no AS spike FROM files)
        SELECT file_id, CAST(CASE WHEN NOT enough THEN now WHEN coalesce(change < -0.08, FALSE) OR spike THEN greatest(now - greatest(now // 4, 1), 1)
            WHEN busy OR now >= 7 THEN now WHEN coalesce(change >= 0.05, FALSE) OR queued > 0 THEN now + 1 ELSE now END AS BIGINT) AS next FROM s""",
    ),
    "k03_bulk_members": (_bulk_loaded, f"WITH {MEMBERS} SELECT kind, group_id, file_id, machine_id FROM members"),
    "k21_telemetry": (_telemetry, f"WITH {CHANGES} SELECT seq, entity, kind, value FROM changes"),
    "k20_enqueued_deletes": (
        lambda s, d: files(s, d).where("review = 'delete' and status <> 'deleted'").select("file_id", "machine_id", "path", F.lit("delete").alias("task")),
        f"WITH {FILES} SELECT file_id, machine_id, path, 'delete' AS task FROM files WHERE review = 'delete' AND status <> 'deleted'",
    ),
    "t02_due_syncs": (
        lambda s, d: changes(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), (F.max("seq") - F.min("seq")).alias("age")).select("entity", sync.due(F.col("n") * 1000, F.col("age")).alias("why")),
        f"WITH {CHANGES} SELECT entity, CASE WHEN count(*) * 1000 >= 50000 THEN 'backlog' WHEN max(seq) - min(seq) >= 300 THEN 'interval' END AS why FROM changes GROUP BY 1",
    ),
    "t03_pull": (
        _consumers,
        f"""WITH {CHANGES}, c AS (SELECT entity AS consumer, min(seq) AS cursor, max(seq) AS last FROM changes GROUP BY 1),
        b AS (SELECT entity AS consumer, seq FROM changes JOIN c ON consumer = entity WHERE seq > cursor AND cursor >= 39 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq) <= 10),
        g AS (SELECT consumer, count(*) AS n, max(seq) AS upto FROM b GROUP BY 1)
        SELECT c.consumer, CASE WHEN cursor < 39 THEN 'snapshot' ELSE 'pull' END AS mode, coalesce(n, 0) AS n, CASE WHEN cursor < 39 THEN last ELSE coalesce(upto, cursor) END AS ack FROM c LEFT JOIN g USING (consumer)""",
    ),
    "t10_health": (
        lambda s, d: changes(s, d).groupBy("entity").agg(F.count_if(F.col("kind") == "purchase").alias("passed"), F.count_if((F.col("kind") == "error") & (F.col("value") < 2)).alias("failed"), F.count_if((F.col("kind") == "signup") & (F.col("value") > 98)).alias("pending")).select("entity", sync.health(F.col("passed"), F.col("failed"), F.col("pending")).alias("state")),
        f"WITH {CHANGES} SELECT entity, CASE WHEN count(*) FILTER (kind = 'error' AND value < 2) > 0 OR count(*) FILTER (kind = 'signup' AND value > 98) > 0 THEN 'degraded' ELSE 'healthy' END AS state FROM changes GROUP BY 1",
    ),
}
