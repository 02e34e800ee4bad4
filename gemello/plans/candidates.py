"""Queries of candidate joins, scores and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gemello.functions.hashing import cosine, cosine_r, hamming, shares_band
from gemello.operators import cluster, joins, scoring
from gemello.sources.inventory import FILES, FRAMES, HAMMING_SQL, IMAGES, files, frames, images

ASPECT_SQL = "abs(CAST(a.width AS DOUBLE) * b.height - CAST(b.width AS DOUBLE) * a.height) <= greatest(CAST(a.width AS DOUBLE) * b.height, CAST(b.width AS DOUBLE) * a.height) * 0.1 * (1 + 2.220446049250313e-16)"


def _band_sql(bands: str, n: int) -> str:
    return "(" + " OR ".join(f"a.{bands}[{i}] = b.{bands}[{i}]" for i in range(1, n + 1)) + ")"


_EDGE_LIMIT = 22
EDGES = (
    IMAGES
    + f""", edges AS (
    SELECT a.image_id AS "left", b.image_id AS "right", {HAMMING_SQL} AS distance
    FROM images a JOIN images b ON a.image_id < b.image_id AND {_band_sql("bands8", 8)}
    WHERE a.quality >= 50 AND b.quality >= 50 AND {ASPECT_SQL} AND {HAMMING_SQL} <= {_EDGE_LIMIT})"""
)


def edges(spark, d):
    return joins.screened_images(images(spark, d), "bands8", _EDGE_LIMIT)


def _stage2(spark, d):
    i = images(spark, d).withColumn("parts", F.transform("bands8", lambda b: b.bitwiseAND(127)))
    pairs = joins.with_sides(edges(spark, d), i, "image_id", ["parts", "embedding"])
    parts = scoring.passed_parts(F.col("l_parts"), F.col("r_parts"), 2)
    near = cosine(F.col("l_embedding"), F.col("r_embedding"))
    verdict = F.when(parts < 4, "no").when(near >= 0.3, "yes").otherwise("no")
    return pairs.select("left", "right", parts.alias("parts"), F.round(near, 6).alias("cosine"), verdict.alias("verdict"))


def _slots(spark, d):
    f = frames(spark, d)
    near = F.aggregate(F.zip_with("l_bands", "r_bands", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    pairs = joins.band_join(f, "video_id", "bands", "slot")
    rows = scoring.slot_pairs(pairs, f, "video_id", ["bands"])
    return rows.withColumn("similarity", F.when(near <= 31, 1 - near / 64).otherwise(0.0)).withColumn("valid", F.lit(True))


_SLOT_SQL = (
    FRAMES
    + """, pairs AS (
    SELECT DISTINCT a.video_id AS "left", b.video_id AS "right" FROM frames a JOIN frames b ON a.slot = b.slot AND a.video_id < b.video_id
    AND (a.bands[1] = b.bands[1] OR a.bands[2] = b.bands[2] OR a.bands[3] = b.bands[3] OR a.bands[4] = b.bands[4])),
slots AS (
    SELECT p."left", p."right", list_sum(list_transform(range(1, 5), lambda i: bit_count(xor(a.bands[i], b.bands[i])))) AS near
    FROM pairs p JOIN frames a ON a.video_id = p."left" JOIN frames b ON b.video_id = p."right" AND b.slot = a.slot),
judged AS (
    SELECT "left", "right", count(*) AS n_valid, count(*) FILTER (near <= 31) AS n_passed,
           sum(CASE WHEN near <= 31 THEN 1 - near / 64.0::DOUBLE ELSE 0 END) AS total FROM slots GROUP BY ALL)"""
)

_REACH = """, links AS MATERIALIZED (SELECT "left" AS a, "right" AS b FROM edges UNION SELECT "right", "left" FROM edges),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
components AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)"""

_COS_SQL = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


def _exact_locations(spark, d):
    """Connected contents expanded to live copies, groups of two contents or more."""
    comp = cluster.connected_components(edges(spark, d))
    i = images(spark, d).select(F.col("image_id"), F.concat(F.lit("content"), F.col("image_id").cast("string")).alias("content"))
    f = files(spark, d).select("file_id", "machine_id", "path", "status", F.concat(F.lit("content"), (F.col("file_id") % 500).cast("string")).alias("content"))
    named = comp.join(i, F.col("node") == F.col("image_id")).select(F.col("content").alias("node"), "component")
    return cluster.confirmed_groups(named, f).select("component", "node", "file_id")


CATALOG = {
    "j01_band_join": (
        lambda s, d: joins.screened_images(images(s, d)),
        f"""WITH {IMAGES} SELECT a.image_id AS "left", b.image_id AS "right", {HAMMING_SQL} AS distance, a.quality AS l_quality, b.quality AS r_quality
        FROM images a JOIN images b ON a.image_id < b.image_id AND {_band_sql("bands", 4)}
        WHERE a.quality >= 50 AND b.quality >= 50 AND {ASPECT_SQL} AND {HAMMING_SQL} <= 31""",
    ),
    "j01_band_join_wide": (
        lambda s, d: edges(s, d).select("left", "right", "distance"),
        f'WITH {EDGES} SELECT "left", "right", distance FROM edges',
    ),
    "j02_band_join_content_key": (
        lambda s, d: joins.screened_images(images(s, d).withColumn("image_id", F.concat(F.lit("k"), F.lpad(F.col("image_id").cast("string"), 8, "0"))), "bands8", _EDGE_LIMIT).select("left", "right", scoring.stage1_score(F.col("distance")).alias("score")),
        f"""WITH {EDGES} SELECT 'k' || lpad("left"::VARCHAR, 8, '0') AS "left", 'k' || lpad("right"::VARCHAR, 8, '0') AS "right", 1 - distance / 256.0::DOUBLE AS score FROM edges""",
    ),
    "j03_slot_band_join": (
        lambda s, d: joins.band_join(frames(s, d), "video_id", "bands", "slot"),
        f'WITH {_SLOT_SQL} SELECT "left", "right" FROM pairs',
    ),
    "j04_range_join": (
        lambda s, d: joins.range_join(images(s, d), "image_id", "duration_ms", 2000),
        f'WITH {IMAGES} SELECT a.image_id AS "left", b.image_id AS "right" FROM images a JOIN images b ON a.image_id < b.image_id AND abs(a.duration_ms - b.duration_ms) <= 2000',
    ),
    "j04_screened_videos": (
        lambda s, d: joins.screened_videos(images(s, d), most=24),
        f"""WITH {IMAGES} SELECT a.image_id AS "left", b.image_id AS "right", {HAMMING_SQL} AS distance
        FROM images a JOIN images b ON a.image_id < b.image_id AND abs(a.duration_ms - b.duration_ms) <= 2000 WHERE {HAMMING_SQL} <= 24""",
    ),
    "c01_canonical_pairs": (
        lambda s, d: scoring.canonical(edges(s, d).select(F.when(F.col("left") % 2 == 0, F.col("right")).otherwise(F.col("left")).alias("left"), F.when(F.col("left") % 2 == 0, F.col("left")).otherwise(F.col("right")).alias("right"), F.when(F.col("left") % 2 == 0, F.col("r_quality")).otherwise(F.col("l_quality")).alias("l_quality"), F.when(F.col("left") % 2 == 0, F.col("l_quality")).otherwise(F.col("r_quality")).alias("r_quality")), "left", "right"),
        f'WITH {EDGES} SELECT "left", "right", "left" * 37 % 101 AS l_quality, "right" * 37 % 101 AS r_quality FROM edges',
    ),
    "c02_image_stage1_score": (
        lambda s, d: edges(s, d).select("left", "right", scoring.stage1_score(F.col("distance")).alias("score")),
        f'WITH {EDGES} SELECT "left", "right", 1 - distance / 256.0::DOUBLE AS score FROM edges',
    ),
    "c03_image_stage2": (
        _stage2,
        f"""WITH {EDGES}, s AS (
            SELECT e."left", e."right", CAST(len(list_filter(range(1, 9), lambda i: bit_count(xor(a.bands8[i] & 127, b.bands8[i] & 127)) <= 2)) AS INTEGER) AS parts, {_COS_SQL} AS c
            FROM edges e JOIN images a ON a.image_id = e."left" JOIN images b ON b.image_id = e."right")
        SELECT "left", "right", parts, round(c, 6) AS cosine, CASE WHEN parts < 4 THEN 'no' WHEN c >= 0.3 THEN 'yes' ELSE 'no' END AS verdict FROM s""",
    ),
    "c04_image_stage2_joint": (
        lambda s, d: joins.with_sides(edges(s, d), images(s, d), "image_id", ["bands8", "embedding"]).select("left", "right", F.when((scoring.passed_parts(F.col("l_bands8"), F.col("r_bands8"), 2) >= 4) & (cosine_r(F.col("l_embedding"), F.col("r_embedding")) >= F.lit(0.3).cast("float")), "passed").otherwise("rejected").alias("verdict")),
        f"""WITH {EDGES} SELECT e."left", e."right", CASE WHEN len(list_filter(range(1, 9), lambda i: bit_count(xor(a.bands8[i], b.bands8[i])) <= 2)) >= 4 AND CAST({_COS_SQL} AS FLOAT) >= 0.3::FLOAT THEN 'passed' ELSE 'rejected' END AS verdict
        FROM edges e JOIN images a ON a.image_id = e."left" JOIN images b ON b.image_id = e."right" """,
    ),
    "c07_video_stage1_mean": (
        lambda s, d: scoring.video_verdict(_slots(s, d), t=scoring.R).select("left", "right", "verdict"),
        f"""WITH {_SLOT_SQL} SELECT "left", "right", CASE WHEN n_valid < 4 THEN 'inconclusive' WHEN total / n_valid >= 0.8 THEN 'yes' ELSE 'no' END AS verdict FROM judged""",
    ),
    "c09_verdict_counts": (
        lambda s, d: scoring.video_verdict(_slots(s, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {_SLOT_SQL} SELECT CASE WHEN n_valid < 4 THEN 'inconclusive' WHEN total / n_valid >= 0.8 OR n_passed >= 4 THEN 'yes' ELSE 'no' END AS verdict, count(*) AS n FROM judged GROUP BY 1""",
    ),
    "c10_connected_components": (
        lambda s, d: cluster.connected_components(edges(s, d)),
        f"WITH RECURSIVE {EDGES}{_REACH} SELECT node, component FROM components",
    ),
    "c12_star_clusters": (
        lambda s, d: cluster.star_clusters(edges(s, d)),
        f"""WITH RECURSIVE {EDGES}, links AS MATERIALIZED (SELECT "left" AS a, "right" AS b FROM edges UNION SELECT "right", "left" FROM edges),
        near AS MATERIALIZED (SELECT a AS node, list(b) AS ends, row_number() OVER (ORDER BY a) AS i FROM links GROUP BY a),
        scan AS (
            SELECT 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS rep, []::BIGINT[] AS got UNION ALL
            SELECT n.i, CASE WHEN list_contains(s.used, n.node) THEN s.used ELSE list_concat(s.used, [n.node], list_filter(n.ends, lambda x: NOT list_contains(s.used, x))) END,
                   CASE WHEN list_contains(s.used, n.node) THEN NULL ELSE n.node END, list_filter(n.ends, lambda x: NOT list_contains(s.used, x))
            FROM scan s JOIN near n ON n.i = s.i + 1)
        SELECT unnest(list_concat([rep], got)) AS node, rep AS representative FROM scan WHERE rep IS NOT NULL AND len(got) > 0""",
    ),
    "c13_location_evidence": (
        lambda s, d: cluster.connected_components(edges(s, d)).join(edges(s, d).select(F.col("left").alias("component"), F.col("right").alias("node"), scoring.stage1_score(F.col("distance")).alias("score")), ["component", "node"], "left").select("node", "component", F.when(F.col("node") == F.col("component"), 1.0).otherwise(F.col("score")).alias("stage1")),
        f"""WITH RECURSIVE {EDGES}{_REACH} SELECT node, component, CASE WHEN node = component THEN 1.0 ELSE 1 - distance / 256.0::DOUBLE END AS stage1
        FROM components LEFT JOIN edges ON "left" = component AND "right" = node""",
    ),
    "c14_confirmed_groups": (
        _exact_locations,
        f"""WITH RECURSIVE {EDGES}{_REACH}, {FILES}, live AS (
            SELECT component, 'content' || node AS node, file_id FROM components JOIN files ON file_id % 500 = node AND status <> 'deleted')
        SELECT component, node, file_id FROM live WHERE component IN (SELECT component FROM live GROUP BY 1 HAVING count(DISTINCT node) >= 2)""",
    ),
    "c15_member_explanation": (
        lambda s, d: cluster.best_edge(edges(s, d).withColumn("score", scoring.stage1_score(F.col("distance"))), "score").select("node", F.to_json(F.struct(F.lit("member").alias("role"), F.col("left"), F.col("right"))).alias("explanation")),
        f"""WITH {EDGES}, ends AS (SELECT "left" AS node, * FROM edges UNION ALL SELECT "right", * FROM edges)
        SELECT node, '{{"role":"member","left":' || "left" || ',"right":' || "right" || '}}' AS explanation FROM ends
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY distance, "left", "right") = 1""",
    ),
    "c18_stage2_plan": (
        lambda s, d: edges(s, d).select(F.explode(F.array("left", "right")).alias("node")).distinct().withColumn("missing", F.when(F.col("node") % 3 == 0, 8).otherwise(0) + F.when(F.col("node") % 2 == 0, 16).otherwise(0)).where("missing != 0"),
        f"""WITH {EDGES}, ends AS (SELECT "left" AS node FROM edges UNION SELECT "right" FROM edges)
        SELECT node, CASE WHEN node % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN node % 2 = 0 THEN 16 ELSE 0 END AS missing FROM ends WHERE node % 3 = 0 OR node % 2 = 0""",
    ),
    "c20_missing_items": (
        lambda s, d: edges(s, d).withColumn("kind", F.when(F.col("distance") % 2 == 0, "image").otherwise("video")).select(F.explode(F.array("left", "right")).alias("node"), "kind").groupBy("node").agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind")).where("kinds = 1").select("node", "kind"),
        f"""WITH {EDGES}, ends AS (SELECT "left" AS node, distance FROM edges UNION ALL SELECT "right", distance FROM edges)
        SELECT node, min(CASE WHEN distance % 2 = 0 THEN 'image' ELSE 'video' END) AS kind FROM ends GROUP BY node HAVING count(DISTINCT distance % 2) = 1""",
    ),
    "w10_best_edge": (
        lambda s, d: cluster.best_edge(edges(s, d).withColumn("score", scoring.stage1_score(F.col("distance"))), "score"),
        f"""WITH {EDGES}, ends AS (SELECT "left" AS node, * FROM edges UNION ALL SELECT "right", * FROM edges)
        SELECT node, "left", "right", 1 - distance / 256.0::DOUBLE AS score FROM ends QUALIFY row_number() OVER (PARTITION BY node ORDER BY distance, "left", "right") = 1""",
    ),
    "f01_hamming": (
        lambda s, d: (lambda i: i.alias("a").join(i.alias("b"), F.col("b.image_id") == F.col("a.image_id") + 1).select(F.col("a.image_id").alias("image_id"), hamming(F.col("a.bands8"), F.col("b.bands8")).alias("distance"), shares_band(F.col("a.bands8"), F.col("b.bands8")).alias("shares")))(images(s, d)),
        f"WITH {IMAGES} SELECT a.image_id, {HAMMING_SQL} AS distance, {_band_sql('bands8', 8)} AS shares FROM images a JOIN images b ON b.image_id = a.image_id + 1",
    ),
    "f05_cosine": (
        lambda s, d: (lambda i: i.alias("a").join(i.alias("b"), F.col("b.image_id") == F.col("a.image_id") + 1).select(F.col("a.image_id").alias("image_id"), F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine")))(images(s, d)),
        f"WITH {IMAGES} SELECT a.image_id, round({_COS_SQL}, 6) AS cosine FROM images a JOIN images b ON b.image_id = a.image_id + 1",
    ),
    "s16_ordered_lookup": (
        lambda s, d: joins.numbered(edges(s, d).select(F.col("left").alias("asked")).distinct(), "asked").join(images(s, d).select("image_id", "quality"), F.col("asked") == F.col("image_id"), "left").select("pos", "asked", "quality"),
        f"""WITH {EDGES}, k AS (SELECT DISTINCT "left" AS asked FROM edges)
        SELECT row_number() OVER (ORDER BY asked) - 1 AS pos, asked, asked * 37 % 101 AS quality FROM k""",
    ),
}
