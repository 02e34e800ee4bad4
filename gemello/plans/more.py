"""Queries of the remaining operators: cache lookups, result files, planning, exports and record keeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gemello.functions import hashing
from gemello.operators import cluster, joins, merge, scoring, stats
from gemello.plans.candidates import _REACH, EDGES, edges
from gemello.sources.inventory import CHANGES, FILES, HAMMING_SQL, IMAGES, MEMBERS, changes, files, images, members, table

_CONTENTS = FILES + ", contents AS (SELECT content, size, min(file_id) AS first_id, count(*) AS n, max(quality) AS quality FROM files GROUP BY 1, 2)"


def _contents(s, d):
    return files(s, d).groupBy("content", "size").agg(F.min("file_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max("quality").alias("quality"))


def _candidates(s, d):
    """Candidate pairs whose endpoints are files by number, with live copies on both sides."""
    f = files(s, d).where("status != 'deleted'")
    e = edges(s, d)
    a, b = (f.select(F.col("file_id").alias(k), F.col("machine_id").alias(f"{k}_machine")) for k in ("left", "right"))
    return e.join(a, "left").join(b, "right")


CATALOG = {
    "s06_features_by_content": (
        lambda s, d: images(s, d).join(files(s, d).where("disk_no = 1").select(F.col("file_id").alias("image_id")), "image_id", "left_semi").select("image_id", "quality"),
        f"WITH {IMAGES} SELECT image_id, quality FROM images WHERE image_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 1)",
    ),
    "s13_candidate_members": (
        lambda s, d: _candidates(s, d).select("left", "right", "left_machine", "right_machine"),
        f"""WITH {EDGES}, {FILES} SELECT "left", "right", a.machine_id AS left_machine, b.machine_id AS right_machine FROM edges
        JOIN files a ON a.file_id = "left" AND a.status <> 'deleted' JOIN files b ON b.file_id = "right" AND b.status <> 'deleted'""",
    ),
    "s14_unresolved_endpoints": (
        lambda s, d: images(s, d).join(edges(s, d).where("distance > 20").select(F.explode(F.array("left", "right")).alias("image_id")).distinct(), "image_id", "left_semi").select("image_id", "width", "height"),
        f"""WITH {EDGES} SELECT image_id, width, height FROM images WHERE image_id IN (SELECT "left" FROM edges WHERE distance > 20 UNION SELECT "right" FROM edges WHERE distance > 20)""",
    ),
    "s17_cache_with_frames": (
        lambda s, d: table(s, d, "conversations").where("turn < 6").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"].cast("string")), ",").alias("frames")),
        "SELECT conv_id, string_agg(length(text)::VARCHAR, ',' ORDER BY turn, length(text)) AS frames FROM conversations WHERE turn < 6 GROUP BY 1",
    ),
    "s18_snapshot_page": (lambda s, d: files(s, d).select("file_id", "path").where("file_id > 100").orderBy("file_id").limit(250), f"WITH {FILES} SELECT file_id, path FROM files WHERE file_id > 100 ORDER BY file_id LIMIT 250"),
    "s21_find_member": (lambda s, d: members(files(s, d)).where("machine_id = 'src7'").select("group_id", "path", "size"), f"WITH {MEMBERS} SELECT group_id, path, size FROM members WHERE machine_id = 'src7'"),
    "s23_ordered_candidates": (lambda s, d: edges(s, d).select("left", "right").orderBy("left", "right"), f'WITH {EDGES} SELECT "left", "right" FROM edges ORDER BY 1, 2'),
    "s24_collected_inputs": (
        lambda s, d: (lambda f: f.where("disk_no = 0").select("content", "size", F.lit(True).alias("a")).unionByName(f.where("disk_no = 1").select("content", "size", (F.col("status") == "active").alias("a"))).groupBy("content", "size").agg(F.bool_or("a").alias("available")))(files(s, d)),
        f"WITH {FILES} SELECT content, size, bool_or(disk_no = 0 OR status = 'active') AS available FROM files WHERE disk_no IN (0, 1) GROUP BY 1, 2",
    ),
    "s27_event_batch": (
        lambda s, d: changes(s, d).join(files(s, d).select(F.col("file_id").alias("entity"), "path"), "entity", "left").select("seq", "entity", "path"),
        f"WITH {CHANGES}, {FILES} SELECT seq, entity, path FROM changes LEFT JOIN files ON file_id = entity",
    ),
    "k23_stage1_commit": (
        lambda s, d: (lambda f: merge.merged(f.where("disk_no != 2").select("file_id", F.lit(None).cast("bigint").alias("quality"), F.lit("pending").alias("state")), f.where("disk_no != 0").select("file_id", "quality", F.lit("done").alias("state")), ["file_id"], {"quality": "new", "state": "new"}))(files(s, d)),
        f"WITH {FILES} SELECT file_id, CASE WHEN disk_no <> 0 THEN quality END AS quality, CASE WHEN disk_no <> 0 THEN 'done' ELSE 'pending' END AS state FROM files",
    ),
    "k26_imported_cache": (
        lambda s, d: (lambda f: merge.merged(f.where("disk_no = 0").select("content", "quality").groupBy("content").agg(F.max("quality").alias("quality")), f.where("disk_no = 1").groupBy("content").agg(F.min("quality").alias("quality")), ["content"], {"quality": "new"}))(files(s, d)),
        f"""WITH {FILES}, o AS (SELECT content, max(quality) AS quality FROM files WHERE disk_no = 0 GROUP BY 1), n AS (SELECT content, min(quality) AS quality FROM files WHERE disk_no = 1 GROUP BY 1)
        SELECT coalesce(o.content, n.content) AS content, coalesce(n.quality, o.quality) AS quality FROM o FULL JOIN n ON n.content = o.content""",
    ),
    "p02_unchanged_content": (
        lambda s, d: (lambda m, f: m.join(f.where("status = 'active'").select(F.col("file_id").alias("id"), F.col("content").alias("now"), F.col("size").alias("now_size")), (F.col("file_id") == F.col("id")) & (F.col("group_id") == F.col("now")) & (F.col("size") == F.col("now_size"))).select("group_id", "file_id"))(members(files(s, d)), files(s, d)),
        f"WITH {MEMBERS} SELECT group_id, file_id FROM members",
    ),
    "p13_cache_completeness": (
        lambda s, d: table(s, d, "conversations").where("turn < 6").groupBy("conv_id").agg(F.bit_or(F.expr("shiftleft(1, cast(turn as int))")).alias("present")).select("conv_id", F.lit(63).bitwiseAND(F.bitwise_not("present")).alias("missing")),
        "SELECT conv_id, 63 & ~bit_or((1 << turn)::INTEGER) AS missing FROM conversations WHERE turn < 6 GROUP BY 1",
    ),
    "j11_unmaterialised_pairs": (
        lambda s, d: edges(s, d).join(edges(s, d).where("distance <= 20").select("left", "right"), ["left", "right"], "left_anti").select("left", "right"),
        f'WITH {EDGES} SELECT "left", "right" FROM edges WHERE distance > 20',
    ),
    "j13_ordinality": (
        lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("conv_id", F.posexplode("turns").alias("pos", "turn")),
        "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, turn FROM conversations",
    ),
    "j16_dimensions": (
        lambda s, d: files(s, d).join(images(s, d).where("image_id % 2 = 0").select(F.col("image_id").alias("i"), F.col("width").alias("iw")), F.col("file_id") == F.col("i"), "left").join(images(s, d).select(F.col("image_id").alias("v"), F.col("height").alias("vh")), F.col("file_id") == F.col("v"), "left").select("file_id", F.coalesce("iw", "vh").alias("width")),
        f"WITH {FILES}, {IMAGES} SELECT file_id, coalesce(CASE WHEN image_id % 2 = 0 THEN width END, height) AS width FROM files LEFT JOIN images ON image_id = file_id",
    ),
    "j18_pair_features": (
        lambda s, d: (lambda i: edges(s, d).join(i.select(F.col("image_id").alias("left"), F.col("parts").alias("lp")), "left", "left").join(i.select(F.col("image_id").alias("right"), F.col("parts").alias("rp")), "right", "left").select("left", "right", F.when(F.col("lp").isNull() | F.col("rp").isNull(), "inconclusive").when(scoring.passed_parts(F.col("lp"), F.col("rp"), 2) >= 4, "yes").otherwise("no").alias("verdict")))(images(s, d).where("image_id % 4 != 0").withColumn("parts", F.col("bands8"))),
        f"""WITH {EDGES} SELECT "left", "right", CASE WHEN "left" % 4 = 0 OR "right" % 4 = 0 THEN 'inconclusive' WHEN len(list_filter(range(1, 9), lambda i: bit_count(xor(a.bands8[i], b.bands8[i])) <= 2)) >= 4 THEN 'yes' ELSE 'no' END AS verdict
        FROM edges JOIN images a ON a.image_id = "left" JOIN images b ON b.image_id = "right" """,
    ),
    "j19_files_by_content": (
        lambda s, d: files(s, d).join(_contents(s, d).where("n >= 3").select("content", F.col("n").alias("copies")), "content").select("file_id", "copies"),
        f"WITH {_CONTENTS} SELECT file_id, n AS copies FROM files JOIN contents USING (content) WHERE n >= 3",
    ),
    "j23_copy_selection": (
        lambda s, d: joins.best_copy(files(s, d).where("status = 'active'"), ["content"], [(F.col("quality") >= 50).desc(), F.col("machine_id"), F.col("path")]).select("content", "file_id"),
        f"WITH {FILES} SELECT content, file_id FROM files WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY content ORDER BY (quality >= 50) DESC, machine_id, path) = 1",
    ),
    "a09_pass_ratio": (
        lambda s, d: (lambda i: i.alias("a").join(i.alias("b"), F.col("b.image_id") == F.col("a.image_id") + 1).select(F.col("a.image_id").alias("image_id"), (scoring.passed_parts(F.col("a.bands8"), F.col("b.bands8"), 3) / 8).alias("ratio")))(images(s, d)),
        f"WITH {IMAGES} SELECT a.image_id, len(list_filter(range(1, 9), lambda i: bit_count(xor(a.bands8[i], b.bands8[i])) <= 3)) / 8.0::DOUBLE AS ratio FROM images a JOIN images b ON b.image_id = a.image_id + 1",
    ),
    "a12_wide_histogram": (
        lambda s, d: changes(s, d).groupBy(F.least(F.floor(F.log2(F.greatest(F.col("value"), F.lit(1.0)))), F.lit(15)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH {CHANGES} SELECT CAST(least(floor(log2(greatest(value, 1.0))), 15) AS BIGINT) AS bucket, count(*) AS n FROM changes GROUP BY 1",
    ),
    "o07_sorted_pairs": (lambda s, d: edges(s, d).select("left", "right").orderBy("left", "right"), f'WITH {EDGES} SELECT "left", "right" FROM edges ORDER BY 1, 2'),
    "o09_stage_order": (
        lambda s, d: changes(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.when(F.col("kind") == "signup", 0).when(F.col("kind") == "view", 1).when(F.col("kind") == "click", 2).otherwise(9)).orderBy("place", "kind"),
        f"WITH {CHANGES} SELECT kind, count(*) AS n, CASE kind WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 9 END AS place FROM changes GROUP BY 1",
    ),
    "o10_result_window": (
        lambda s, d: members(files(s, d)).withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("group_id", "path"))).where("n between 11 and 30").select("n", "group_id", "path"),
        f"WITH {MEMBERS} SELECT * FROM (SELECT row_number() OVER (PARTITION BY kind ORDER BY group_id, path) AS n, group_id, path FROM members) WHERE n BETWEEN 11 AND 30",
    ),
    "o11_fault_page": (
        lambda s, d: merge.faults(changes(s, d), ["entity", "kind"], "seq", "props").select("entity", "kind", "occurrences").where("entity > 20 or (entity = 20 and kind > 'click')").orderBy("entity", "kind").limit(51),
        f"WITH {CHANGES} SELECT entity, kind, count(*) AS occurrences FROM changes WHERE entity > 20 OR (entity = 20 AND kind > 'click') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 51",
    ),
    "o12_task_page": (lambda s, d: files(s, d).select("mtime", "file_id").orderBy(F.desc("mtime"), F.desc("file_id")).offset(20).limit(20), f"WITH {FILES} SELECT mtime, file_id FROM files ORDER BY mtime DESC, file_id DESC LIMIT 20 OFFSET 20"),
    "u02_pair_set": (lambda s, d: edges(s, d).select("left", "right").unionByName(edges(s, d).select(F.col("left"), F.col("right"))).dropDuplicates(), f'WITH {EDGES} SELECT "left", "right" FROM edges'),
    "u03_image_and_video_pairs": (
        lambda s, d: joins.screened_images(images(s, d)).select("left", "right", F.lit("image").alias("kind")).unionByName(joins.screened_videos(images(s, d), most=20).select("left", "right", F.lit("video").alias("kind"))),
        f"""WITH {IMAGES} SELECT a.image_id AS "left", b.image_id AS "right", 'image' AS kind FROM images a JOIN images b ON a.image_id < b.image_id AND (a.bands[1] = b.bands[1] OR a.bands[2] = b.bands[2] OR a.bands[3] = b.bands[3] OR a.bands[4] = b.bands[4])
        WHERE a.quality >= 50 AND b.quality >= 50 AND {HAMMING_SQL} <= 31 AND abs(CAST(a.width AS DOUBLE) * b.height - CAST(b.width AS DOUBLE) * a.height) <= greatest(CAST(a.width AS DOUBLE) * b.height, CAST(b.width AS DOUBLE) * a.height) * 0.1 * (1 + 2.220446049250313e-16)
        UNION ALL SELECT a.image_id, b.image_id, 'video' FROM images a JOIN images b ON a.image_id < b.image_id AND abs(a.duration_ms - b.duration_ms) <= 2000 WHERE {HAMMING_SQL} <= 20""",
    ),
    "c11_stable_group_ids": (
        lambda s, d: (lambda c: c.groupBy("component").agg(F.sort_array(F.collect_list(F.col("node").cast("string"))).alias("nodes")).select("component", cluster.group_id(F.lit("run"), F.lit("image"), F.array_join("nodes", "\0")).alias("group_id")))(cluster.connected_components(edges(s, d))),
        f"""WITH RECURSIVE {EDGES}{_REACH}
        SELECT component, 'local-' || substr(sha256('run' || chr(0) || 'image' || chr(0) || string_agg(node::VARCHAR, chr(0) ORDER BY node::VARCHAR)), 1, 32) AS group_id FROM components GROUP BY 1""",
    ),
    "c19_stage2_batches": (
        lambda s, d: (lambda f: f.withColumn("n", F.row_number().over(Window.partitionBy("machine_id").orderBy("content", "file_id"))).select("machine_id", "file_id", F.floor((F.col("n") - 1) / 7).alias("batch")))(joins.best_copy(files(s, d).where("status = 'active'"), ["content"], [F.col("machine_id"), F.col("path")])),
        f"""WITH {FILES}, b AS (SELECT * FROM files WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY content ORDER BY machine_id, path) = 1)
        SELECT machine_id, file_id, (row_number() OVER (PARTITION BY machine_id ORDER BY content, file_id) - 1) // 7 AS batch FROM b""",
    ),
    "c27_selection_digest": (
        lambda s, d: files(s, d).where("review = 'delete'").select("machine_id", F.sha2(F.concat_ws("|", "machine_id", "path", "size", "mtime"), 256).alias("digest")),
        f"WITH {FILES} SELECT machine_id, sha256(machine_id || '|' || path || '|' || size || '|' || mtime) AS digest FROM files WHERE review = 'delete'",
    ),
    "f04_shares_band": (
        lambda s, d: (lambda i: i.alias("a").join(i.alias("b"), F.col("b.image_id") == F.col("a.image_id") + 1).where(hashing.shares_band(F.col("a.bands8"), F.col("b.bands8"))).agg(F.count(F.lit(1)).alias("n")))(images(s, d)),
        f"WITH {IMAGES} SELECT count(*) AS n FROM images a JOIN images b ON b.image_id = a.image_id + 1 WHERE {' OR '.join(f'a.bands8[{i}] = b.bands8[{i}]' for i in range(1, 9))}",
    ),
    "f28_stable_task_ids": (
        lambda s, d: files(s, d).groupBy("machine_id", "disk_no").agg(F.count(F.lit(1)).alias("n")).select("machine_id", "disk_no", F.sha2(F.to_json(F.struct("machine_id", "disk_no", "n")), 256).alias("task_id")),
        f"""WITH {FILES} SELECT machine_id, disk_no, sha256('{{"machine_id":"' || machine_id || '","disk_no":' || disk_no || ',"n":' || count(*) || '}}') AS task_id FROM files GROUP BY 1, 2""",
    ),
    "a11_exact_rank_by_machine": (
        lambda s, d: stats.nearest_rank_95(files(s, d), ["machine_id"], "size"),
        f"WITH {FILES}, r AS (SELECT machine_id, size, row_number() OVER (PARTITION BY machine_id ORDER BY size) AS i, count(*) OVER (PARTITION BY machine_id) AS n FROM files) SELECT machine_id, size AS p95 FROM r WHERE i = (95 * n + 99) // 100",
    ),
}
