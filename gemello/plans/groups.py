"""Queries over groups of exact duplicates and their members."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gemello.functions.paths import basename, contains_text
from gemello.operators import groups as g
from gemello.sources.inventory import FILES, MEMBERS, files, groups, members

_RANK_SQL = "row_number() OVER (PARTITION BY group_id ORDER BY (file_id <> rep_id)::INT, machine_id, path, file_id)"
_RANKED = MEMBERS + f", ranked AS (SELECT *, {_RANK_SQL} AS rep_rank FROM members)"
_SUMMARY = MEMBERS + ", summary AS (SELECT group_id, kind, count(*) AS n_members, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(greatest(sum(size) - max(size), 0) AS BIGINT) AS reclaim_bytes, min(file_id) AS first_id FROM members GROUP BY 1, 2)"


def _m(s, d):
    return members(files(s, d))


def _strategy(name: str, order: str) -> dict:
    return {
        f"w02_strategy_{name}": (
            lambda s, d: g.selection(_m(s, d), name).select("group_id", "file_id"),
            f"""WITH {_RANKED}, kept AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}, file_id) AS keep_rank FROM ranked)
            SELECT group_id, file_id FROM kept WHERE rep_rank <> 1 AND keep_rank <> 1""",
        )
    }


def _page_with_representatives(s, d):
    """The page is cut first; only its groups look for their representative."""
    m = _m(s, d)
    page = g.page(g.summary(m).select("group_id", "n_members", "reclaim_bytes"), [F.desc("reclaim_bytes"), F.asc("group_id")], 2, 10)
    reps = g.representatives(m.join(F.broadcast(page.select("group_id")), "group_id", "left_semi"))
    return page.join(reps, "group_id").select("group_id", "n_members", "reclaim_bytes", "rep_file_id", "rep_path")


CATALOG = {
    "a01_exact_groups": (
        lambda s, d: groups(files(s, d).where("status != 'deleted'")).select("group_id", "rep_id", F.col("n_stored").alias("n_files")),
        f"WITH {FILES} SELECT content AS group_id, min(file_id) AS rep_id, count(*) AS n_files FROM files WHERE status <> 'deleted' GROUP BY 1 HAVING count(*) > 1",
    ),
    "a02_exact_groups_by_key": (
        lambda s, d: files(s, d).where("status != 'deleted'").select("content", "size", "machine_id", "path").distinct().groupBy("content", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("machine_id", "path")).alias("r")).where("n >= 2").select("content", "size", "n", F.col("r.machine_id").alias("rep_machine"), F.col("r.path").alias("rep_path")),
        f"""WITH {FILES} SELECT content, size, count(*) AS n, arg_min(machine_id, (machine_id, path)) AS rep_machine, arg_min(path, (machine_id, path)) AS rep_path
        FROM files WHERE status <> 'deleted' GROUP BY 1, 2 HAVING count(*) >= 2""",
    ),
    "a03_duplicate_summary": (
        lambda s, d: files(s, d).groupBy(F.col("content").alias("content_md5"), "size").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"), ((F.count(F.lit(1)) - 1) * F.max("size")).alias("wasted_bytes"), F.countDistinct("machine_id").alias("n_machines")).where("n_files > 1"),
        """SELECT md5(text) AS content_md5, n_chars AS size, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_bytes,
                  (count(*) - 1) * max(n_chars) AS wasted_bytes, count(DISTINCT source) AS n_machines
           FROM documents GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
    "a04_group_summary": (
        lambda s, d: g.summary(_m(s, d)).withColumn("machines", F.array_join("machines", ",")),
        f"""WITH {MEMBERS} SELECT group_id, kind, count(*) AS n_members, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(greatest(sum(size) - max(size), 0) AS BIGINT) AS reclaim_bytes,
        array_to_string(list_sort(list_distinct(list(machine_id))), ',') AS machines FROM members GROUP BY 1, 2""",
    ),
    "a05_global_stats": (
        lambda s, d: g.stats(_m(s, d)),
        f"WITH {_SUMMARY} SELECT count(*) AS n_groups, CAST(coalesce(sum(n_members), 0) AS BIGINT) AS n_members, CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(reclaim_bytes), 0) AS BIGINT) AS reclaim_bytes FROM summary",
    ),
    "a06_summary_by_representative": (
        lambda s, d: g.summary_by_rep(_m(s, d)),
        f"WITH {_RANKED} SELECT group_id, count(*) AS n_members, CAST(sum(size) - max(size) FILTER (rep_rank = 1) AS BIGINT) AS reclaim_bytes, max(path) FILTER (rep_rank = 1) AS rep_path FROM ranked GROUP BY 1",
    ),
    "a07_conditional_summary": (
        lambda s, d: g.conditional_summary(_m(s, d)),
        f"WITH {_RANKED} SELECT group_id, CAST(sum(CASE WHEN rep_rank <> 1 THEN size ELSE 0 END) AS BIGINT) AS reclaim_bytes, max(CASE WHEN rep_rank = 1 THEN path END) AS rep_path FROM ranked GROUP BY 1",
    ),
    "a08_filtered_group_count": (
        lambda s, d: g.matching(_m(s, d), F.col("machine_id") == "src1", 2).agg(F.count_distinct("group_id").alias("n")),
        f"WITH {MEMBERS} SELECT count(*) AS n FROM (SELECT group_id FROM members GROUP BY 1 HAVING count(*) >= 2 AND bool_or(machine_id = 'src1'))",
    ),
    "a16_delete_summary": (
        lambda s, d: g.delete_summary(g.selection(_m(s, d), "newest")).select("n_files", "n_bytes", F.array_join(F.transform(F.map_entries("machines"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("machines"), F.array_join("samples", ",").alias("samples")),
        f"""WITH {_RANKED}, kept AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY mtime DESC, file_id) AS keep_rank FROM ranked), sel AS (SELECT * FROM kept WHERE rep_rank <> 1 AND keep_rank <> 1),
        per AS (SELECT machine_id, count(*) AS n FROM sel GROUP BY 1), first AS (SELECT path FROM sel ORDER BY path LIMIT 20)
        SELECT (SELECT count(*) FROM sel) AS n_files, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM sel) AS n_bytes, coalesce((SELECT string_agg(machine_id || '=' || n, ',' ORDER BY machine_id) FROM per), '') AS machines,
               coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM first), '') AS samples""",
    ),
    "a17_delete_status": (
        lambda s, d: files(s, d).withColumn("result", F.when(F.col("file_id") % 7 == 0, "failed").when(F.col("file_id") % 5 == 0, "uncertain").when(F.col("file_id") % 3 == 0, "pending").otherwise("ok")).groupBy("machine_id").agg(*[F.sum(F.when(F.col("result") == r, 1).otherwise(0)).alias(f"n_{r}") for r in ("ok", "failed", "uncertain", "pending")]),
        f"""WITH {FILES}, r AS (SELECT *, CASE WHEN file_id % 7 = 0 THEN 'failed' WHEN file_id % 5 = 0 THEN 'uncertain' WHEN file_id % 3 = 0 THEN 'pending' ELSE 'ok' END AS result FROM files)
        SELECT machine_id, count(*) FILTER (result = 'ok') AS n_ok, count(*) FILTER (result = 'failed') AS n_failed, count(*) FILTER (result = 'uncertain') AS n_uncertain, count(*) FILTER (result = 'pending') AS n_pending FROM r GROUP BY 1""",
    ),
    "a18_released_bytes": (
        lambda s, d: files(s, d).agg(F.sum(F.when(F.col("status") == "deleted", F.col("size")).otherwise(0)).alias("released")),
        f"WITH {FILES} SELECT CAST(sum(CASE WHEN status = 'deleted' THEN size ELSE 0 END) AS BIGINT) AS released FROM files",
    ),
    "a19_kind_counts": (
        lambda s, d: g.summary(_m(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {_SUMMARY} SELECT kind, count(*) AS n FROM summary GROUP BY 1",
    ),
    "a21_next_generation": (
        lambda s, d: files(s, d).groupBy("machine_id").agg((F.coalesce(F.max("disk_no"), F.lit(0)) + 1).alias("generation")),
        f"WITH {FILES} SELECT machine_id, coalesce(max(disk_no), 0) + 1 AS generation FROM files GROUP BY 1",
    ),
    "a22_verify_counts": (
        lambda s, d: files(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_paths")),
        f"WITH {FILES} SELECT count(*) AS n, count(DISTINCT path) AS n_paths FROM files",
    ),
    "a23_review_state": (
        lambda s, d: g.review_state(_m(s, d)),
        f"WITH {MEMBERS} SELECT group_id, bool_and(review <> 'undecided') AS reviewed, count(*) FILTER (review = 'keep') AS n_keep, count(*) FILTER (review = 'delete') AS n_delete, count(*) FILTER (review = 'undecided') AS n_undecided FROM members GROUP BY 1",
    ),
    "a24_merged_availability": (
        lambda s, d: files(s, d).groupBy("content", "size").agg(F.bool_or(F.col("status") == "active").alias("available")),
        f"WITH {FILES} SELECT content, size, bool_or(status = 'active') AS available FROM files GROUP BY 1, 2",
    ),
    "a25_groups_by_file": (
        lambda s, d: files(s, d).join(_m(s, d).select(F.col("file_id").alias("m_id"), "group_id"), F.col("file_id") == F.col("m_id"), "left").groupBy("file_id").agg(F.count_distinct("group_id").alias("n_groups")),
        f"WITH {MEMBERS} SELECT f.file_id, count(DISTINCT m.group_id) AS n_groups FROM files f LEFT JOIN members m ON m.file_id = f.file_id GROUP BY 1",
    ),
    "a26_after_delete": (
        lambda s, d: (lambda m: g.after_delete(m, m.where("file_id % 3 = 0")).select("group_id", "file_id", "rep_id"))(_m(s, d)),
        f"""WITH {MEMBERS}, remaining AS (SELECT * FROM members WHERE file_id % 3 <> 0), big AS (SELECT group_id FROM remaining GROUP BY 1 HAVING count(*) >= 2)
        SELECT group_id, file_id, first_value(file_id) OVER (PARTITION BY group_id ORDER BY (file_id <> rep_id)::INT, (review <> 'keep')::INT, machine_id, path, file_id) AS rep_id
        FROM remaining WHERE group_id IN (SELECT group_id FROM big)""",
    ),
    "j05_group_member_file": (
        lambda s, d: _m(s, d).select("group_id", "file_id", "machine_id", "size"),
        f"WITH {MEMBERS} SELECT group_id, file_id, machine_id, size FROM members",
    ),
    "j06_kind_quality": (
        lambda s, d: (lambda m, i: m.join(i, F.col("file_id") == F.col("vec_id"), "left").select("group_id", "file_id", F.when(F.col("disk_no") == 0, F.coalesce("label", F.lit(0))).otherwise(F.coalesce("quality", F.lit(0))).alias("score")))(_m(s, d), s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")),
        f"WITH {MEMBERS} SELECT group_id, file_id, CASE WHEN disk_no = 0 THEN coalesce(label, 0) ELSE coalesce(quality, 0) END AS score FROM members LEFT JOIN embeddings ON vec_id = file_id",
    ),
    "j07_effective_representative": (
        lambda s, d: g.representatives(_m(s, d)),
        f"WITH {_RANKED} SELECT group_id, file_id AS rep_file_id, machine_id AS rep_machine_id, path AS rep_path, size AS rep_size FROM ranked WHERE rep_rank = 1",
    ),
    "j20_delete_guard": (
        lambda s, d: _m(s, d).where("review = 'delete'").join(files(s, d).where("status = 'active'").select("file_id"), "file_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {MEMBERS} SELECT group_id, count(*) AS n FROM members WHERE review = 'delete' GROUP BY 1",
    ),
    "j21_delete_request": (
        lambda s, d: files(s, d).join(g.ranked(_m(s, d)).select(F.col("file_id").alias("m_id"), "group_id", "rep_rank"), F.col("file_id") == F.col("m_id"), "left").select("file_id", "group_id", F.coalesce(F.col("rep_rank") == 1, F.lit(False)).alias("is_representative")),
        f"WITH {_RANKED} SELECT f.file_id, r.group_id, coalesce(r.rep_rank = 1, FALSE) AS is_representative FROM files f LEFT JOIN ranked r ON r.file_id = f.file_id",
    ),
    "w01_representative_rank": (
        lambda s, d: g.ranked(_m(s, d)).select("group_id", "file_id", "rep_rank"),
        f"WITH {_RANKED} SELECT group_id, file_id, rep_rank FROM ranked",
    ),
    **_strategy("newest", "mtime DESC"),
    **_strategy("oldest", "mtime"),
    **_strategy("largest", "size DESC"),
    **_strategy("shortest_path", "length(path)"),
    "w03_representative_first": (
        lambda s, d: _m(s, d).withColumn("n", F.row_number().over(Window.partitionBy("group_id").orderBy((F.col("file_id") == F.col("rep_id")).desc(), "machine_id", "path"))).select("group_id", "file_id", "n"),
        f"WITH {MEMBERS} SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY (file_id = rep_id) DESC, machine_id, path) AS n FROM members",
    ),
    "w04_active_first": (
        lambda s, d: (lambda f: groups(f).select("group_id", "rep_id").join(f, F.col("group_id") == F.col("content")).withColumn("n", F.row_number().over(Window.partitionBy("group_id").orderBy((F.col("status") == "active").desc(), (F.col("file_id") == F.col("rep_id")).desc(), "machine_id", "path"))).select("group_id", "file_id", "n"))(files(s, d)),
        f"WITH {MEMBERS} SELECT group_id, f.file_id, row_number() OVER (PARTITION BY group_id ORDER BY (status = 'active') DESC, (f.file_id = rep_id) DESC, machine_id, path) AS n FROM groups JOIN files f ON content = group_id",
    ),
    "w05_best_copy": (
        lambda s, d: files(s, d).withColumn("n", F.row_number().over(Window.partitionBy("content").orderBy((F.col("disk_no") == 0).desc(), "machine_id", "path", "file_id"))).where("n = 1").select("content", "file_id"),
        f"WITH {FILES} SELECT content, file_id FROM files QUALIFY row_number() OVER (PARTITION BY content ORDER BY (disk_no = 0) DESC, machine_id, path, file_id) = 1",
    ),
    "w06_new_representative": (
        lambda s, d: _m(s, d).where("review = 'keep'").groupBy("group_id").agg(F.min_by("file_id", F.struct("machine_id", "path", "file_id")).alias("new_rep")),
        f"WITH {MEMBERS} SELECT group_id, arg_min(file_id, (machine_id, path, file_id)) AS new_rep FROM members WHERE review = 'keep' GROUP BY 1",
    ),
    "w07_total_before_limit": (
        lambda s, d: (lambda sel: sel.orderBy("group_id", "file_id").limit(25).crossJoin(F.broadcast(sel.agg(F.count(F.lit(1)).alias("total")))).select("group_id", "file_id", "total"))(g.selection(_m(s, d), "newest")),
        f"""WITH {_RANKED}, kept AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY mtime DESC, file_id) AS keep_rank FROM ranked)
        SELECT group_id, file_id, count(*) OVER () AS total FROM kept WHERE rep_rank <> 1 AND keep_rank <> 1 ORDER BY group_id, file_id LIMIT 25""",
    ),
    "w11_best_representative": (
        lambda s, d: _m(s, d).groupBy("group_id").agg(F.min_by("file_id", F.struct((-F.col("quality")).alias("q"), "machine_id", "path", "file_id")).alias("best")),
        f"WITH {MEMBERS} SELECT group_id, arg_min(file_id, (-quality, machine_id, path, file_id)) AS best FROM members GROUP BY 1",
    ),
    "w12_quick_rule": (
        lambda s, d: g.quick_rule(_m(s, d), F.col("quality")).select("group_id", "file_id", "mark"),
        f"WITH {MEMBERS} SELECT group_id, file_id, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, machine_id DESC, path DESC) = 1 THEN 'keep' ELSE 'delete' END AS mark FROM members",
    ),
    "w13_shards": (
        lambda s, d: g.shards(files(s, d), "machine_id", ["path", "file_id"], 10).select("machine_id", "file_id", "shard"),
        f"WITH {FILES} SELECT machine_id, file_id, (row_number() OVER (PARTITION BY machine_id ORDER BY path, file_id) - 1) // 10 AS shard FROM files",
    ),
    "w09_round_robin": (
        lambda s, d: g.fair_order(files(s, d), "machine_id", ["path", "file_id"]).select("machine_id", "file_id", "turn"),
        f"WITH {FILES} SELECT machine_id, file_id, row_number() OVER (PARTITION BY machine_id ORDER BY path, file_id) AS turn FROM files",
    ),
    "p03_kind_filter": (lambda s, d: g.matching(_m(s, d), F.lit(True), 1, ["exact"]).select("group_id", "file_id"), f"WITH {MEMBERS} SELECT group_id, file_id FROM members WHERE kind = 'exact'"),
    "p04_any_member_filter": (
        lambda s, d: g.matching(_m(s, d), (F.col("machine_id") == "src2") & contains_text(F.col("path"), "DE/")).select("group_id", "file_id"),
        f"WITH {MEMBERS} SELECT group_id, file_id FROM members WHERE group_id IN (SELECT group_id FROM members WHERE machine_id = 'src2' AND strpos(lower(path), 'de/') > 0)",
    ),
    "p06_basename_filter": (
        lambda s, d: files(s, d).where(contains_text(basename(F.col("path")), "7.j")).select("file_id"),
        f"WITH {FILES} SELECT file_id FROM files WHERE contains(lower(split_part(path, '/', -1)), '7.j')",
    ),
    "p07_size_range": (lambda s, d: files(s, d).where(F.col("size").between(500, 1500)).select("file_id", "size"), f"WITH {FILES} SELECT file_id, size FROM files WHERE size BETWEEN 500 AND 1500"),
    "p08_review_filter": (
        lambda s, d: g.review_state(_m(s, d)).where("reviewed").select("group_id"),
        f"WITH {MEMBERS} SELECT group_id FROM members GROUP BY 1 HAVING bool_and(review <> 'undecided')",
    ),
    "p16_min_members": (lambda s, d: g.summary(_m(s, d)).where("n_members >= 3").select("group_id", "n_members"), f"WITH {_SUMMARY} SELECT group_id, n_members FROM summary WHERE n_members >= 3"),
    "o01_offset_page": (
        lambda s, d: g.page(g.summary(_m(s, d)).select("group_id", "n_members", "reclaim_bytes"), [F.desc("n_members"), F.asc("group_id")], 2, 20),
        f"WITH {_SUMMARY} SELECT group_id, n_members, reclaim_bytes FROM summary ORDER BY n_members DESC, group_id LIMIT 20 OFFSET 20",
    ),
    "o01_page_with_representatives": (
        _page_with_representatives,
        f"""WITH {_RANKED}, page AS (SELECT group_id, count(*) AS n_members, CAST(sum(size) - max(size) AS BIGINT) AS reclaim_bytes FROM members GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10 OFFSET 10)
        SELECT p.group_id, n_members, reclaim_bytes, r.file_id AS rep_file_id, r.path AS rep_path FROM page p JOIN ranked r ON r.group_id = p.group_id AND rep_rank = 1""",
    ),
    "o02_group_keyset_page": (
        lambda s, d: g.after(g.summary(_m(s, d)).select("kind", "group_id", "n_members"), ["kind", "group_id"], ("exact", "8"), 15),
        f"WITH {_SUMMARY} SELECT kind, group_id, n_members FROM summary WHERE kind > 'exact' OR (kind = 'exact' AND group_id > '8') ORDER BY kind, group_id LIMIT 16",
    ),
    "o03_member_keyset_page": (
        lambda s, d: g.after(_m(s, d).select("machine_id", "path", "file_id"), ["machine_id", "path"], ("src12", "C:/en"), 30),
        f"WITH {MEMBERS} SELECT machine_id, path, file_id FROM members WHERE machine_id > 'src12' OR (machine_id = 'src12' AND path > 'C:/en') ORDER BY 1, 2 LIMIT 31",
    ),
    "o04_member_offset_page": (
        lambda s, d: g.page(_m(s, d).select("group_id", (F.col("file_id") != F.col("rep_id")).alias("other"), "machine_id", "path", "file_id"), [F.col("group_id"), F.col("other"), F.col("machine_id"), F.col("path")], 3, 10).select("group_id", "file_id"),
        f"WITH {MEMBERS} SELECT group_id, file_id FROM members ORDER BY group_id, (file_id <> rep_id), machine_id, path LIMIT 10 OFFSET 20",
    ),
    "o05_row_window": (
        lambda s, d: g.summary(_m(s, d)).select("group_id").orderBy("group_id").offset(5).limit(12),
        f"WITH {_SUMMARY} SELECT group_id FROM summary ORDER BY 1 LIMIT 12 OFFSET 5",
    ),
    "o06_top_wasted": (
        lambda s, d: g.summary(_m(s, d)).select("group_id", "reclaim_bytes").orderBy(F.desc("reclaim_bytes"), "group_id").limit(100),
        f"WITH {_SUMMARY} SELECT group_id, reclaim_bytes FROM summary ORDER BY reclaim_bytes DESC, group_id LIMIT 100",
    ),
    "o08_truncating_selection": (
        lambda s, d: (lambda sel: sel.orderBy("file_id").limit(20).select("file_id", F.lit(True).alias("listed")).crossJoin(F.broadcast(sel.agg((F.count(F.lit(1)) > 20).alias("truncated")))))(g.selection(_m(s, d), "largest")),
        f"""WITH {_RANKED}, kept AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, file_id) AS keep_rank FROM ranked), sel AS (SELECT file_id FROM kept WHERE rep_rank <> 1 AND keep_rank <> 1)
        SELECT file_id, TRUE AS listed, (SELECT count(*) > 20 FROM sel) AS truncated FROM sel ORDER BY file_id LIMIT 20""",
    ),
    "o13_active_and_latest": (
        lambda s, d: (lambda f: f.where("review = 'undecided'").select("file_id", "mtime").unionByName(f.where("review != 'undecided'").select("file_id", "mtime").orderBy(F.desc("mtime"), F.desc("file_id")).limit(200)))(files(s, d)),
        f"WITH {FILES} SELECT file_id, mtime FROM files WHERE review = 'undecided' UNION ALL (SELECT file_id, mtime FROM files WHERE review <> 'undecided' ORDER BY mtime DESC, file_id DESC LIMIT 200)",
    ),
    "c22_keep_strategy": (
        lambda s, d: g.selection(_m(s, d), "newest").groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_bytes")),
        f"""WITH {_RANKED}, kept AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY mtime DESC, file_id) AS keep_rank FROM ranked)
        SELECT machine_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM kept WHERE rep_rank <> 1 AND keep_rank <> 1 GROUP BY 1""",
    ),
    "c23_set_representative": (
        lambda s, d: (lambda m: m.join(m.groupBy("group_id").agg(F.max("file_id").alias("asked")), "group_id").select("group_id", "file_id", F.col("asked").alias("rep_id"), (F.col("file_id") == F.col("asked")).alias("is_rep")))(_m(s, d)),
        f"WITH {MEMBERS} SELECT group_id, file_id, max(file_id) OVER (PARTITION BY group_id) AS rep_id, file_id = max(file_id) OVER (PARTITION BY group_id) AS is_rep FROM members",
    ),
    "c24_quick_review": (
        lambda s, d: g.quick_rule(_m(s, d), F.col("size")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_bytes")),
        f"""WITH {MEMBERS}, q AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY size DESC, machine_id DESC, path DESC) = 1 THEN 'keep' ELSE 'delete' END AS mark FROM members)
        SELECT mark, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM q GROUP BY 1""",
    ),
    "c25_delete_prepare": (
        lambda s, d: g.ranked(_m(s, d)).select("file_id", "machine_id", "path", F.when(F.col("rep_rank") == 1, "is_representative").otherwise("ok").alias("check")),
        f"WITH {_RANKED} SELECT file_id, machine_id, path, CASE WHEN rep_rank = 1 THEN 'is_representative' ELSE 'ok' END AS \"check\" FROM ranked",
    ),
    "c26_delete_plan": (
        lambda s, d: g.delete_plan(_m(s, d)).select("group_id", "file_id"),
        f"WITH {_RANKED} SELECT group_id, file_id FROM ranked WHERE review = 'delete' AND rep_rank <> 1 AND group_id IN (SELECT group_id FROM members WHERE review = 'keep')",
    ),
}
