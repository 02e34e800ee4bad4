"""Queries of merges, change folds, reconciliation, telemetry and incremental reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gemello.operators import joins, merge, stats
from gemello.sources.inventory import CHANGES, FILES, changes, files
from gemello.streaming import sync

_BOUNDS = stats.BOUNDS_US
_BUCKET_SQL = "CASE WHEN us < 0 THEN NULL " + " ".join(f"WHEN us <= {b} THEN {i}" for i, b in enumerate(_BOUNDS)) + f" WHEN us IS NOT NULL THEN {len(_BOUNDS)} END"
_LATENCY_SQL = CHANGES + f", lat AS (SELECT *, CAST(floor(value * 1000) AS BIGINT) AS us FROM changes), hist AS (SELECT kind, {_BUCKET_SQL} AS bucket, count(*) AS n FROM lat GROUP BY 1, 2 HAVING {_BUCKET_SQL} IS NOT NULL)".replace(f"HAVING {_BUCKET_SQL} IS NOT NULL", "HAVING bucket IS NOT NULL")


def _old(s, d):
    return files(s, d).where("file_id % 4 != 0").select("file_id", "machine_id", "size", "quality", (F.col("status") == "active").alias("active"), F.when(F.col("file_id") % 6 == 0, None).otherwise(F.col("content")).alias("content"))


def _new(s, d):
    f = files(s, d).where("file_id % 3 != 0")
    return f.select("file_id", "machine_id", F.when(F.col("file_id") % 5 == 0, 0).otherwise(F.col("size") + 1).alias("size"), (F.col("quality") + 20).alias("quality"), (F.col("file_id") % 7 == 0).alias("active"), F.when(F.col("file_id") % 2 == 0, None).otherwise(F.upper("content")).alias("content"))


_OLD_NEW = (
    FILES
    + """, old AS (SELECT file_id, machine_id, size, quality, status = 'active' AS active, CASE WHEN file_id % 6 = 0 THEN NULL ELSE content END AS content FROM files WHERE file_id % 4 <> 0),
new AS (SELECT file_id, machine_id, CASE WHEN file_id % 5 = 0 THEN 0 ELSE size + 1 END AS size, quality + 20 AS quality, file_id % 7 = 0 AS active, CASE WHEN file_id % 2 = 0 THEN NULL ELSE upper(content) END AS content FROM files WHERE file_id % 3 <> 0)"""
)


def _latency(s, d):
    return changes(s, d).withColumn("us", F.floor(F.col("value") * 1000))


def _tasks(s, d):
    return changes(s, d).groupBy("entity").agg(F.max("seq").alias("highest"), F.max(F.when(F.col("kind") != "click", F.col("seq"))).alias("synced"), F.max_by("kind", "seq").alias("state"))


CATALOG = {
    "k01_replace_by_kind": (
        lambda s, d: files(s, d).withColumn("kind", F.when(F.col("disk_no") == 0, "exact").otherwise("image")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("n_contents")),
        f"WITH {FILES} SELECT CASE WHEN disk_no = 0 THEN 'exact' ELSE 'image' END AS kind, count(*) AS n, count(DISTINCT content) AS n_contents FROM files GROUP BY 1",
    ),
    "k04_scores_kept": (
        lambda s, d: (lambda f: merge.scores_kept(f.where("file_id % 2 = 0").select("file_id", "content"), f.where("file_id % 3 = 0").select("file_id", "content"), ["file_id"], "content"))(files(s, d)),
        f"WITH {FILES} SELECT file_id, content FROM files WHERE file_id % 2 = 0 OR file_id % 3 = 0",
    ),
    "k05_without_stale": (
        lambda s, d: (lambda f: merge.without_stale(f.select((F.col("file_id") + 1).alias("left"), F.col("file_id").alias("right")), f.where("file_id % 3 = 0").select(F.col("file_id").alias("left"), (F.col("file_id") + 1).alias("right"))))(files(s, d)),
        f'WITH {FILES} SELECT file_id + 1 AS "left", file_id AS "right" FROM files WHERE file_id % 3 = 0',
    ),
    "k06_enumerated": (
        lambda s, d: merge.enumerated(files(s, d).where("file_id % 4 != 0").select("machine_id", "path", "size", "mtime", "content", "status"), files(s, d).select("machine_id", "path", (F.col("size") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("size"), "mtime"), ["machine_id", "path"]),
        f"""WITH {FILES} SELECT machine_id, path, size + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS size, mtime,
        CASE WHEN file_id % 4 <> 0 AND file_id % 5 <> 0 AND status <> 'deleted' THEN content END AS content, CASE WHEN file_id % 4 <> 0 AND file_id % 5 <> 0 AND status <> 'deleted' THEN status ELSE 'pending' END AS status FROM files""",
    ),
    "k07_hashed": (
        lambda s, d: (lambda f: merge.hashed(f.select("file_id", F.lit(None).cast("string").alias("content"), F.lit(3).alias("missing")), f.where("file_id % 3 = 0").select("file_id", "content"), "file_id"))(files(s, d)),
        f"WITH {FILES} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN content END AS content, CASE WHEN file_id % 3 = 0 THEN 2 ELSE 3 END AS missing FROM files",
    ),
    "k08_central_merge": (
        lambda s, d: merge.merged(_old(s, d), _new(s, d), ["file_id"], {"machine_id": "new", "size": "positive", "content": "new"}),
        f"""WITH {_OLD_NEW} SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(n.machine_id, o.machine_id) AS machine_id, CASE WHEN n.size > 0 THEN n.size ELSE o.size END AS size, coalesce(n.content, o.content) AS content
        FROM old o FULL JOIN new n ON n.file_id = o.file_id""",
    ),
    "k09_children_replaced": (
        lambda s, d: (lambda f: merge.children_replaced(f.where("disk_no = 0").select("machine_id", "file_id"), f.where("disk_no = 1 and machine_id < 'src15'").select("machine_id", "file_id"), "machine_id"))(files(s, d)),
        f"""WITH {FILES} SELECT machine_id, file_id FROM files WHERE disk_no = 1 AND machine_id < 'src15'
        UNION ALL SELECT machine_id, file_id FROM files WHERE disk_no = 0 AND machine_id NOT IN (SELECT machine_id FROM files WHERE disk_no = 1 AND machine_id < 'src15')""",
    ),
    "k10_sticky_merge": (
        lambda s, d: merge.merged(_old(s, d), _new(s, d), ["file_id"], {"active": "sticky", "quality": "quality", "size": "last"}),
        f"""WITH {_OLD_NEW} SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.active, FALSE) OR coalesce(n.active, FALSE) AS active, CASE WHEN n.quality BETWEEN 0 AND 100 THEN n.quality ELSE o.quality END AS quality,
        CASE WHEN n.file_id IS NOT NULL THEN n.size ELSE o.size END AS size FROM old o FULL JOIN new n ON n.file_id = o.file_id""",
    ),
    "k11_cursor": (
        lambda s, d: changes(s, d).groupBy("entity").agg(F.max("seq").alias("cursor")),
        f"WITH {CHANGES} SELECT entity, max(seq) AS cursor FROM changes GROUP BY 1",
    ),
    "k12_snapshot_replace": (
        lambda s, d: (lambda f: merge.snapshot(f.select("machine_id", "path", F.lit(True).alias("active")), f.where("machine_id = 'src3' and file_id % 2 = 0").select("machine_id", "path"), ["machine_id", "path"], "src3"))(files(s, d)),
        f"WITH {FILES} SELECT machine_id, path, NOT (machine_id = 'src3' AND file_id % 2 <> 0) AS active FROM files",
    ),
    "k13_reconciled": (
        lambda s, d: (lambda f: merge.reconciled(f.where("file_id % 4 != 0").select("path", "size", "mtime"), f.where("file_id % 3 != 0").select("path", (F.col("size") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("size"), "mtime"), "path"))(files(s, d)),
        f"""WITH {FILES} SELECT path, CASE WHEN file_id % 4 = 0 THEN 'insert' WHEN file_id % 3 = 0 THEN 'deactivate' WHEN file_id % 5 = 0 THEN 'update' ELSE 'skip' END AS action
        FROM files WHERE NOT (file_id % 4 = 0 AND file_id % 3 = 0)""",
    ),
    "k19_faults": (
        lambda s, d: merge.faults(changes(s, d), ["entity", "kind"], "seq", "props"),
        f"WITH {CHANGES} SELECT entity, kind, count(*) AS occurrences, min(seq) AS first_at, max(seq) AS last_at, arg_max(props, seq) AS message FROM changes GROUP BY 1, 2",
    ),
    "k20_soft_delete": (
        lambda s, d: (lambda f: f.join(f.where("file_id % 50 = 0").select(F.col("path").alias("gone")), F.col("path") == F.col("gone"), "left").select("file_id", F.when(F.col("gone").isNotNull(), "deleted").otherwise(F.col("status")).alias("status")))(files(s, d)),
        f"WITH {FILES} SELECT file_id, CASE WHEN file_id % 50 = 0 THEN 'deleted' ELSE status END AS status FROM files",
    ),
    "k22_review_marks": (
        lambda s, d: sync.latest(changes(s, d).select("entity", "kind", "seq", "value"), ["entity", "kind"], "seq"),
        f"WITH {CHANGES} SELECT entity, kind, seq, value FROM changes QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY seq DESC) = 1",
    ),
    "k25_content_location": (
        lambda s, d: (lambda f: f.where("file_id % 2 = 1").select("content", "size").distinct().join(f.where("file_id % 2 = 0").select("content", "size").distinct(), ["content", "size"], "left_anti"))(files(s, d)),
        f"WITH {FILES} SELECT content, size FROM files WHERE file_id % 2 = 1 EXCEPT SELECT content, size FROM files WHERE file_id % 2 = 0",
    ),
    "k28_crash_recovery": (
        lambda s, d: merge.recovered(changes(s, d).select("seq", F.element_at(F.array(*map(F.lit, merge.TRANSITIONS)), (F.col("seq") % 11 + 1).cast("int")).alias("state"))),
        f"""WITH {CHANGES}, t AS (SELECT seq, [{", ".join(repr(x) for x in merge.TRANSITIONS)}][seq % 11 + 1] AS state FROM changes)
        SELECT seq, CASE WHEN state IN ('pending', 'running') THEN 'waiting_recovery' WHEN state = 'pausing' THEN 'paused' WHEN state = 'stopping' THEN 'cancelled' ELSE state END AS state FROM t""",
    ),
    "p17_task_transitions": (
        lambda s, d: (lambda c: merge.allowed(c, "origin", "to").groupBy("origin", "to").agg(F.count(F.lit(1)).alias("n")))(changes(s, d).select(F.element_at(F.array(*map(F.lit, merge.TRANSITIONS)), (F.col("seq") % 11 + 1).cast("int")).alias("origin"), F.element_at(F.array(*map(F.lit, merge.TRANSITIONS)), (F.col("entity") % 11 + 1).cast("int")).alias("to"))),
        f"""WITH {CHANGES}, names AS (SELECT [{", ".join(repr(x) for x in merge.TRANSITIONS)}] AS a), ok(origin, dest) AS (VALUES {", ".join(f"({a!r}, {b!r})" for a, bs in merge.TRANSITIONS.items() for b in bs)})
        SELECT a[seq % 11 + 1] AS origin, a[entity % 11 + 1] AS "to", count(*) AS n FROM changes, names WHERE (a[seq % 11 + 1], a[entity % 11 + 1]) IN (SELECT (origin, dest) FROM ok) GROUP BY 1, 2""",
    ),
    "p18_stage_gate": (
        lambda s, d: stats.gates(_tasks(s, d).withColumn("run", F.col("entity") % 40), "run", ("view", "purchase", "signup", "logout")),
        f"""WITH {CHANGES}, t AS (SELECT entity, max(seq) AS highest, max(seq) FILTER (kind <> 'click') AS synced, arg_max(kind, seq) AS state FROM changes GROUP BY 1)
        SELECT entity % 40 AS run, CASE WHEN bool_and(state IN ('view', 'purchase', 'signup', 'logout') AND coalesce(synced, -1) >= highest) THEN 'ready' ELSE 'waiting' END AS gate FROM t GROUP BY 1""",
    ),
    "j08_stale_under_roots": (
        lambda s, d: joins.stale(files(s, d).where("status = 'active'").select("file_id", "path"), files(s, d).where("file_id % 3 != 0").select("path"), s.createDataFrame([("C:/de",), ("C:/en/src1",)], "root string")).select("file_id"),
        f"WITH {FILES} SELECT file_id FROM files WHERE status = 'active' AND file_id % 3 = 0 AND (starts_with(path, 'C:/de/') OR starts_with(path, 'C:/en/src1/'))",
    ),
    "j09_pairs_without_candidate": (
        lambda s, d: files(s, d).select("file_id").join(changes(s, d).select(F.col("entity").alias("file_id")).distinct(), "file_id", "left_anti"),
        f"WITH {FILES}, {CHANGES} SELECT file_id FROM files WHERE NOT EXISTS (SELECT 1 FROM changes WHERE entity = file_id)",
    ),
    "j10_orphan_queue": (
        lambda s, d: changes(s, d).select("seq", "entity").join(files(s, d).where("status = 'active'").select(F.col("file_id").alias("entity")), "entity", "left_anti"),
        f"WITH {FILES}, {CHANGES} SELECT entity, seq FROM changes WHERE NOT EXISTS (SELECT 1 FROM files WHERE file_id = entity AND status = 'active')",
    ),
    "j12_without_pending_deletions": (
        lambda s, d: files(s, d).where("status = 'active'").join(changes(s, d).where("kind = 'click'").select(F.col("entity").alias("file_id")), "file_id", "left_anti").select("file_id"),
        f"WITH {FILES}, {CHANGES} SELECT file_id FROM files WHERE status = 'active' AND file_id NOT IN (SELECT entity FROM changes WHERE kind = 'click')",
    ),
    "j14_using_distinct": (
        lambda s, d: (lambda f: f.select("content", "size").join(f.where("quality >= 50").select("content", "size", "quality"), ["content", "size"]).distinct())(files(s, d)),
        f"WITH {FILES} SELECT DISTINCT content, size, b.quality FROM files a JOIN files b USING (content, size) WHERE b.quality >= 50",
    ),
    "j15_current_active": (
        lambda s, d: (lambda f: f.select("file_id", "content").join(f.where("status = 'active' and file_id % 5 != 0").select("file_id", F.col("content").alias("now")), "file_id", "left").select("file_id", F.coalesce(F.col("now") == F.col("content"), F.lit(False)).alias("current_active")))(files(s, d)),
        f"WITH {FILES} SELECT file_id, status = 'active' AND file_id % 5 <> 0 AS current_active FROM files",
    ),
    "j17_pair_copies": (
        lambda s, d: (lambda f: f.where("disk_no = 0").select("content", F.col("file_id").alias("l")).join(f.where("disk_no = 1").select("content", F.col("file_id").alias("r")), "content"))(files(s, d)),
        f"WITH {FILES} SELECT a.content, a.file_id AS l, b.file_id AS r FROM files a JOIN files b ON a.content = b.content AND a.disk_no = 0 AND b.disk_no = 1",
    ),
    "j22_longest_prefix": (
        lambda s, d: joins.longest_prefix(files(s, d), "path", s.createDataFrame([("C:",), ("C:/en",), ("C:/en/src4",), ("C:/fr",)], "root string"), "root", "file_id").select("file_id", "root"),
        f"""WITH {FILES}, roots(root) AS (VALUES ('C:'), ('C:/en'), ('C:/en/src4'), ('C:/fr'))
        SELECT file_id, arg_max(root, length(root)) AS root FROM files JOIN roots ON starts_with(path, root || '/') GROUP BY 1""",
    ),
    "f30_change_fold": (
        lambda s, d: merge.folded(changes(s, d).select("entity", "seq", F.when(F.col("kind") != "view", F.col("kind")).alias("kind"), (F.col("value") - 20).alias("amount"), (F.col("seq") % 97 == 0).alias("flag"), (F.col("seq") % 150).alias("quality")), "entity", "seq", {"kind": "new", "amount": "positive", "flag": "sticky", "quality": "quality"}),
        f"""WITH {CHANGES}, c AS (SELECT entity, seq, CASE WHEN kind <> 'view' THEN kind END AS kind, value - 20 AS amount, seq % 97 = 0 AS flag, seq % 150 AS quality FROM changes)
        SELECT entity, max(seq) AS last_seq, arg_max(kind, seq) FILTER (kind IS NOT NULL) AS kind, arg_max(amount, seq) FILTER (amount > 0) AS amount, bool_or(flag) AS flag, arg_max(quality, seq) FILTER (quality BETWEEN 0 AND 100) AS quality FROM c GROUP BY 1""",
    ),
    "a11_latency_histogram": (lambda s, d: stats.histogram(_latency(s, d), ["kind"], "us"), f"WITH {_LATENCY_SQL} SELECT kind, bucket, n FROM hist"),
    "a11_merged_percentile": (
        lambda s, d: stats.percentile(stats.merged(stats.histogram(_latency(s, d), ["kind", "entity"], "us"), ["kind"]), ["kind"], 0.95),
        f"""WITH {_LATENCY_SQL}, seen AS (SELECT kind, bucket, sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY kind) AS total FROM hist)
        SELECT kind, CAST([{", ".join(map(str, _BOUNDS))}][least(min(bucket), {len(_BOUNDS) - 1}) + 1] AS BIGINT) AS upper_us FROM seen WHERE seen >= floor(total::DOUBLE * 0.95 + 0.999999999) GROUP BY kind""",
    ),
    "a13_nearest_rank_95": (
        lambda s, d: stats.nearest_rank_95(changes(s, d), ["kind"], "value"),
        f"WITH {CHANGES}, r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS i, count(*) OVER (PARTITION BY kind) AS n FROM changes) SELECT kind, value AS p95 FROM r WHERE i = (95 * n + 99) // 100",
    ),
    "a14_telemetry_rollup": (
        lambda s, d: stats.rollup(changes(s, d).withColumn("cents", F.floor(F.col("value") * 100)), "ts", "kind", "cents", 3600).select(F.unix_seconds("window_start").alias("window_s"), "kind", "n", "total"),
        f"WITH {CHANGES} SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_s, kind, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS total FROM changes GROUP BY 1, 2",
    ),
    "a15_throughput": (
        lambda s, d: stats.throughput(files(s, d), "machine_id", "size"),
        f"WITH {FILES} SELECT machine_id, CASE WHEN size < 1000 THEN 0 WHEN size < 10000 THEN 1 ELSE 2 END AS size_bucket, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM files GROUP BY 1, 2",
    ),
    "t05_generation_race": (
        lambda s, d: (lambda c: sync.merged(c.where("seq % 2 = 1"), c.where("seq % 2 = 0"), ["entity"], "seq"))(changes(s, d).select("entity", "seq", "kind")),
        f"WITH {CHANGES} SELECT entity, seq, kind FROM changes QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq DESC) = 1",
    ),
    "t04_dead_letters": (
        lambda s, d: sync.split_valid(changes(s, d), (F.col("value") > 1) & F.col("props").startswith("{"))[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {CHANGES} SELECT kind, count(*) AS n FROM changes WHERE NOT coalesce(value > 1 AND starts_with(props, '{{'), FALSE) GROUP BY 1",
    ),
    "t06_recent_samples": (
        lambda s, d: stats.last_samples(changes(s, d).withColumn("cents", F.floor(F.col("value") * 100)), "ts", "kind", "cents", 300).select("seq", "recent_n", "recent_sum"),
        f"""WITH {CHANGES}, c AS (SELECT seq, kind, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(value * 100) AS BIGINT) AS cents FROM changes)
        SELECT seq, count(*) OVER w AS recent_n, CAST(sum(cents) OVER w AS BIGINT) AS recent_sum FROM c WINDOW w AS (PARTITION BY kind ORDER BY s RANGE BETWEEN 299 PRECEDING AND CURRENT ROW)""",
    ),
    "t08_fair_batch": (
        lambda s, d: sync.fair_batch(changes(s, d).select("kind", "seq"), "kind", ["seq"], 60).select("kind", "seq"),
        f"WITH {CHANGES}, q AS (SELECT kind, seq, row_number() OVER (PARTITION BY kind ORDER BY seq) AS turn FROM changes) SELECT kind, seq FROM q ORDER BY turn, seq LIMIT 60",
    ),
    "event_windows": (
        lambda s, d: sync.windows(changes(s, d).withColumn("cents", F.floor(F.col("value") * 100)), "ts", "kind", "cents", "1 hour").select(F.unix_seconds("window_start").alias("window_s"), "kind", "n", "total"),
        f"WITH {CHANGES} SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_s, kind, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS total FROM changes GROUP BY 1, 2",
    ),
    "w08_fair_queue": (
        lambda s, d: changes(s, d).select("kind", "seq", F.row_number().over(Window.partitionBy("kind").orderBy("seq")).alias("turn")),
        f"WITH {CHANGES} SELECT kind, seq, row_number() OVER (PARTITION BY kind ORDER BY seq) AS turn FROM changes",
    ),
    "s19_change_log": (lambda s, d: changes(s, d).where("seq > 500").orderBy("seq").limit(1000).select("seq", "entity", "kind"), f"WITH {CHANGES} SELECT seq, entity, kind FROM changes WHERE seq > 500 ORDER BY seq LIMIT 1000"),
}
