"""Queries of scans, predicates, scalar functions, set operations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gemello.functions import hashing, paths
from gemello.sources.inventory import FILES, IMAGES, files, images, table
from gemello.sources.tsv import lines


def _pages(s, d):
    return table(s, d, "pages").select("page_id", "url")


CATALOG = {
    "s01_live_files": (lambda s, d: files(s, d).where("status != 'deleted' and content is not null").select("content", "file_id"), f"WITH {FILES} SELECT content, file_id FROM files WHERE status <> 'deleted'"),
    "s02_image_features": (lambda s, d: images(s, d).where("quality >= 50").select("image_id", "quality"), f"WITH {IMAGES} SELECT image_id, quality FROM images WHERE quality >= 50"),
    "s03_video_features": (lambda s, d: images(s, d).where("duration_ms is not null").select("image_id", "duration_ms", F.coalesce("quality", F.lit(0)).alias("quality")), f"WITH {IMAGES} SELECT image_id, duration_ms, coalesce(quality, 0) AS quality FROM images"),
    "s04_files_by_content": (
        lambda s, d: (lambda f: f.join(f.where("file_id % 10 = 0").select("content").distinct(), "content", "left_semi").select("file_id"))(files(s, d)),
        f"WITH {FILES} SELECT file_id FROM files WHERE content IN (SELECT content FROM files WHERE file_id % 10 = 0)",
    ),
    "s05_machine_files": (lambda s, d: files(s, d).where("machine_id = 'src5' and status != 'deleted'").select("file_id", "path"), f"WITH {FILES} SELECT file_id, path FROM files WHERE machine_id = 'src5' AND status <> 'deleted'"),
    "s07_rooted_files": (
        lambda s, d: files(s, d).where(paths.is_within(paths.normalized(F.col("path")), F.lit("C:\\EN"))).select("file_id"),
        f"WITH {FILES} SELECT file_id FROM files WHERE starts_with(path, 'C:/en/')",
    ),
    "s08_pending_by_disk": (
        lambda s, d: files(s, d).where(F.col("quality").cast("int").bitwiseAND(5) != 0).groupBy("disk_no").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")),
        f"WITH {FILES} SELECT disk_no, count(*) AS n, min(path) AS first FROM files WHERE quality & 5 <> 0 GROUP BY 1",
    ),
    "s12_media_files": (
        lambda s, d: files(s, d).where(F.lower(paths.extension(F.col("path"))).isin(".jpg", ".mp4")).select("file_id"),
        f"WITH {FILES} SELECT file_id FROM files WHERE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) IN ('.jpg', '.mp4')",
    ),
    "s22_files_with_contents": (
        lambda s, d: (lambda f: f.where("status = 'active'").join(f.groupBy("content").agg(F.max("quality").alias("best")), "content", "left").select("file_id", "best"))(files(s, d)),
        f"WITH {FILES} SELECT file_id, best FROM files LEFT JOIN (SELECT content, max(quality) AS best FROM files GROUP BY 1) USING (content) WHERE status = 'active'",
    ),
    "s25_benchmark_corpus": (
        lambda s, d: s.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") - F.col("id") % 40).otherwise(F.col("id")).alias("cluster"), (F.col("id") * 2654435761 % 4294967296).alias("hash")),
        "SELECT range AS id, CASE WHEN range % 10 = 0 THEN range - range % 40 ELSE range END AS cluster, range * 2654435761 % 4294967296 AS hash FROM range(2000)",
    ),
    "s26_content_probe": (
        lambda s, d: files(s, d).select("file_id", hashing.missing_mask([(F.when(F.col("file_id") % 2 == 0, F.col("content")), 1), (F.when(F.col("file_id") % 3 == 0, F.col("size")), 2), (F.when(F.col("file_id") % 5 == 0, F.col("quality")), 8)]).alias("missing")),
        f"WITH {FILES} SELECT file_id, CASE WHEN file_id % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN file_id % 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN file_id % 5 <> 0 THEN 8 ELSE 0 END AS missing FROM files",
    ),
    "s28_container_metadata": (
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_streams"), F.to_json(F.sort_array(F.collect_list(F.struct("event_id", "event_type")))).alias("streams")).select("user_id", "n_streams", "streams"),
        """SELECT user_id, count(*) AS n_streams, '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS streams FROM events GROUP BY 1""",
    ),
    "p01_live": (lambda s, d: files(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"WITH {FILES} SELECT status, count(*) AS n FROM files GROUP BY 1"),
    "p05_path_contains": (lambda s, d: files(s, d).where(paths.contains_text(F.col("path"), "SRC1/")).select("file_id"), f"WITH {FILES} SELECT file_id FROM files WHERE strpos(lower(path), 'src1/') > 0"),
    "p09_near_aspect": (
        lambda s, d: (lambda i: i.alias("a").join(i.alias("b"), F.col("b.image_id") == F.col("a.image_id") + 1).where(hashing.close_aspect(F.col("a.width"), F.col("a.height"), F.col("b.width"), F.col("b.height"), 0.1)).select(F.col("a.image_id").alias("image_id")))(images(s, d)),
        f"""WITH {IMAGES} SELECT a.image_id FROM images a JOIN images b ON b.image_id = a.image_id + 1 WHERE
        abs(CAST(a.width AS DOUBLE) * b.height - CAST(b.width AS DOUBLE) * a.height) <= greatest(CAST(a.width AS DOUBLE) * b.height, CAST(b.width AS DOUBLE) * a.height) * 0.1 * (1 + 2.220446049250313e-16)""",
    ),
    "p10_near_aspect_single": (
        lambda s, d: (lambda i: i.alias("a").join(i.alias("b"), F.col("b.image_id") == F.col("a.image_id") + 1).where(hashing.close_aspect_r(F.col("a.width"), F.col("a.height"), F.col("b.width"), F.col("b.height"), 0.1)).select(F.col("a.image_id").alias("image_id")))(images(s, d)),
        f"""WITH {IMAGES}, r AS (SELECT a.image_id, CAST(a.width AS FLOAT) / CAST(a.height AS FLOAT) AS x, CAST(b.width AS FLOAT) / CAST(b.height AS FLOAT) AS y FROM images a JOIN images b ON b.image_id = a.image_id + 1)
        SELECT image_id FROM r WHERE CAST(abs(CAST(x AS FLOAT) - CAST(y AS FLOAT)) AS FLOAT) / greatest(CAST(x AS FLOAT), CAST(y AS FLOAT)) <= 0.1::FLOAT""",
    ),
    "p11_digest_validator": (
        lambda s, d: files(s, d).select("file_id", hashing.is_digest(F.when(F.col("file_id") % 3 == 0, F.upper("content")).otherwise(F.col("content")), 32).alias("ok")),
        f"WITH {FILES} SELECT file_id, regexp_full_match(CASE WHEN file_id % 3 = 0 THEN upper(content) ELSE content END, '[0-9a-f]{{32}}') AS ok FROM files",
    ),
    "p14_stage_state": (
        lambda s, d: files(s, d).select("file_id", hashing.stage_state((F.col("file_id") % 4).cast("int"), F.lit(3), F.col("file_id") % 8 == 3).alias("state")),
        f"WITH {FILES} SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'done' WHEN 3 THEN CASE WHEN file_id % 8 = 3 THEN 'failed' ELSE 'pending' END ELSE 'partial' END AS state FROM files",
    ),
    "p15_media_kind": (
        lambda s, d: files(s, d).select("file_id", paths.media_kind(F.col("path")).alias("kind")),
        f"WITH {FILES} SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'image' WHEN 3 THEN 'video' ELSE 'other' END AS kind FROM files",
    ),
    "p19_finite_vectors": (lambda s, d: images(s, d).select("image_id", hashing.finite(F.col("embedding")).alias("ok")), f"WITH {IMAGES} SELECT image_id, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS ok FROM images"),
    "u01_stored_and_inconclusive": (
        lambda s, d: (lambda f: f.groupBy("content").count().where("count > 1").select(F.col("content").alias("group_id")).unionByName(f.where("quality < 5").select(F.concat(F.lit("inconclusive:"), F.col("file_id").cast("string")).alias("group_id"))))(files(s, d)),
        f"WITH {FILES} SELECT content AS group_id FROM files GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT 'inconclusive:' || file_id FROM files WHERE quality < 5",
    ),
    "u04_endpoints": (
        lambda s, d: files(s, d).select(F.explode(F.array("disk_no", F.col("quality"))).alias("node")).distinct(),
        f"WITH {FILES} SELECT disk_no AS node FROM files UNION SELECT quality FROM files",
    ),
    "u05_remaining_slots": (
        lambda s, d: files(s, d).select("file_id", F.array_join(F.array_except(F.sequence(F.lit(0), F.lit(5)), F.array((F.col("file_id") % 6).cast("int"), (F.col("quality") % 6).cast("int"))), ",").alias("slots")),
        f"WITH {FILES} SELECT file_id, array_to_string(list_filter(range(6), lambda x: x <> file_id % 6 AND x <> quality % 6), ',') AS slots FROM files",
    ),
    "u06_uncovered_masks": (
        lambda s, d: files(s, d).select("file_id", F.col("quality").bitwiseAND(F.bitwise_not(F.col("disk_no") * 3)).alias("mask")).where("mask != 0"),
        f"WITH {FILES} SELECT file_id, quality & ~(disk_no * 3) AS mask FROM files WHERE quality & ~(disk_no * 3) <> 0",
    ),
    "u07_remaining_paths": (lambda s, d: (lambda f: f.select("path").join(f.where("file_id % 4 = 0").select("path"), "path", "left_anti"))(files(s, d)), f"WITH {FILES} SELECT path FROM files EXCEPT SELECT path FROM files WHERE file_id % 4 = 0"),
    "u08_distinct_rows": (lambda s, d: files(s, d).select("machine_id", "disk_no").distinct(), f"WITH {FILES} SELECT DISTINCT machine_id, disk_no FROM files"),
    "f10_content_digests": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256")),
        "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    ),
    "f12_normalized_paths": (
        lambda s, d: files(s, d).select("file_id", paths.normalized(F.concat(F.lit("c:/x/../"), F.substring("path", 4, 1000), F.lit("/./y"))).alias("path")),
        f"WITH {FILES} SELECT file_id, 'C:\\' || upper(replace(substr(path, 4), '/', '\\')) || '\\Y' AS path FROM files",
    ),
    "f15_basename_extension": (
        lambda s, d: _pages(s, d).select("page_id", paths.basename(F.col("url")).alias("base"), paths.extension(F.col("url")).alias("ext")),
        "SELECT page_id, split_part(url, '/', -1) AS base, regexp_extract(split_part(url, '/', -1), '(\\.[^.]*)$', 1) AS ext FROM pages",
    ),
    "f17_cursor_text": (lambda s, d: files(s, d).select("file_id", F.lpad(F.col("file_id").cast("string"), 20, "0").alias("text"), F.hex("file_id").alias("hexed")), f"WITH {FILES} SELECT file_id, lpad(file_id::VARCHAR, 20, '0') AS text, to_hex(file_id) AS hexed FROM files"),
    "f21_frame_midpoints": (
        lambda s, d: images(s, d).select("image_id", F.array_join(hashing.midpoints(F.col("duration_ms")), ",").alias("at")),
        f"WITH {IMAGES} SELECT image_id, array_to_string(list_transform(range(6), lambda i: duration_ms * (2 * i + 1) // 12), ',') AS at FROM images",
    ),
    "f22_json_scores": (
        lambda s, d: table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("doc")),
        """SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS doc FROM events""",
    ),
    "f26_tsv_escape": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.md5(paths.tsv(F.col("text"))).alias("digest")),
        "SELECT doc_id, md5(replace(replace(replace(replace(text, chr(9), '\\x09'), chr(13), '\\x0d'), chr(10), '\\x0a'), chr(0), '\\x00')) AS digest FROM documents",
    ),
    "k16_result_lines": (
        lambda s, d: lines(files(s, d), ["content", "machine_id", "path", "size"], ["content", "path"]),
        f"WITH {FILES} SELECT 'M' || chr(9) || content || chr(9) || machine_id || chr(9) || path || chr(9) || size AS value FROM files",
    ),
    "k17_summary_export": (
        lambda s, d: files(s, d).select("path", F.sha2(F.concat_ws("\t", "content", F.col("size").cast("string")), 256).alias("payload"), F.when(F.col("status") == "deleted", "MISSING").when(F.col("quality") < 50, "INCONCLUSIVE").otherwise("PASS").alias("state")),
        f"WITH {FILES} SELECT path, sha256(content || chr(9) || size) AS payload, CASE WHEN status = 'deleted' THEN 'MISSING' WHEN quality < 50 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS state FROM files",
    ),
    "c29_worst_status": (
        lambda s, d: files(s, d).groupBy("content").agg(F.max(F.when(F.col("status") == "deleted", 2).when(F.col("quality") < 50, 1).otherwise(0)).alias("worst")),
        f"WITH {FILES} SELECT content, max(CASE WHEN status = 'deleted' THEN 2 WHEN quality < 50 THEN 1 ELSE 0 END) AS worst FROM files GROUP BY 1",
    ),
}
