import random

import pytest
from pyspark.sql import functions as F

from gemello.operators import cluster, groups, joins, merge, scoring, stats
from gemello.operators.config import G, R, Thresholds


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bands(spark, rows):
    return spark.createDataFrame(rows, "image_id long, bands array<long>, quality int, width int, height int, duration_ms long")


def random_images(n, seed):
    rng = random.Random(seed)
    pool = [[rng.getrandbits(16) for _ in range(4)] for _ in range(n // 3)]
    out = []
    for i in range(n):
        b = list(rng.choice(pool))
        b[rng.randrange(4)] ^= 1 << rng.randrange(16) if rng.random() < 0.7 else 0
        out.append((i, b, rng.choice([30, 49, 50, 90]), rng.choice([0, 100, 105, 200]), 100, rng.choice([-3000, -1, 0, 1999, 2000, 4001, 9000])))
    return out


def test_band_join_against_all_pairs(spark):
    rows = random_images(120, 1)
    got = {(r.left, r.right): r.distance for r in joins.screened_images(bands(spark, rows)).collect()}
    want = {}
    for a in rows:
        for b in rows:
            distance = sum(bin(x ^ y).count("1") for x, y in zip(a[1], b[1]))
            near = a[3] == 0 or b[3] == 0 or abs(a[3] * 100 - b[3] * 100) <= 0.1 * max(a[3], b[3]) * 100 * (1 + 2**-52)
            if a[0] < b[0] and min(a[2], b[2]) >= 50 and any(x == y for x, y in zip(a[1], b[1])) and distance <= 31 and near:
                want[a[0], b[0]] = distance
    assert got == want and len(want) > 20
    shuffled = {(r.left, r.right) for r in joins.screened_images(bands(spark, random.Random(2).sample(rows, len(rows))).repartition(5)).collect()}
    assert shuffled == set(want)


def test_joins_are_equi_joins(spark):
    df = bands(spark, random_images(30, 3))
    for out in (joins.band_join(df, "image_id", "bands"), joins.range_join(df, "image_id", "duration_ms", 2000)):
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


@pytest.mark.parametrize("width", [0, 1, 2000])
def test_range_join_against_all_pairs(spark, width):
    rng = random.Random(width)
    big = (1 << 63) - 1
    values = [rng.randrange(-5000, 5000) for _ in range(80)] + [big, -big - 1, big - 1, 2000, 4000, 4001, None]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long")
    got = sorted((r.left, r.right) for r in joins.range_join(df, "k", "v", width).collect())
    assert got == sorted((i, j) for i, x in enumerate(values) for j, y in enumerate(values) if i < j and None not in (x, y) and abs(x - y) <= width)


def test_band_recall_of_three_bits(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        b = [rng.getrandbits(64) - (1 << 63) for _ in range(4)]
        near = list(b)
        for _ in range(3):
            near[rng.randrange(4)] ^= 1 << rng.randrange(62)
        rows += [(2 * i, b, 90, 1, 1, 0), (2 * i + 1, near, 90, 1, 1, 0)]
    got = {(r.left, r.right) for r in joins.screened_images(bands(spark, rows)).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(300)} <= got


def test_ordered_lookup_and_prefixes(spark):
    asked = spark.createDataFrame([([3, 1, 3, 9],)], "keys array<long>")
    known = spark.createDataFrame([(1, "a"), (3, "c")], "k long, v string")
    assert [(r.pos, r.asked, r.v) for r in joins.in_order(asked, "keys", known, "k").orderBy("pos").collect()] == [(0, 3, "c"), (1, 1, "a"), (2, 3, "c"), (3, 9, None)]
    paths = spark.createDataFrame([(1, "C:/a/b/c"), (2, "C:/ab"), (3, "D:/x")], "id long, path string")
    roots = spark.createDataFrame([("C:/a",), ("C:/a/b",), ("C:",)], "root string")
    assert {(r.id, r.root) for r in joins.longest_prefix(paths, "path", roots, "root", "id").collect()} == {(1, "C:/a/b"), (2, "C:")}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "left long, right long")


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


def stars(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    used, out = set(), {}
    for n in sorted(near):
        if n not in used:
            taken = {m for m in near[n] if m not in used and m != n}
            used |= {n} | taken
            if taken:
                out |= {m: n for m in taken | {n}}
    return out


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(2, 1), (1, 2), (1, 2), (3, 2), (9, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)]])
def test_components(spark, pairs):
    got = {r.node: r.component for r in cluster.connected_components(edges(spark, pairs)).collect()}
    assert got == union_find(pairs)


def test_components_and_stars_of_random_graphs(spark):
    rng = random.Random(7)
    for n in (30, 60):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        assert {r.node: r.component for r in cluster.connected_components(edges(spark, pairs)).collect()} == union_find(pairs)
        assert {r.node: r.representative for r in cluster.star_clusters(edges(spark, pairs)).collect()} == stars(pairs)


def test_stars_of_long_chains(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(30)] + [(3, 9), (100, 101)]
    for few in (cluster.FEW, 12):
        monkeypatch.setattr(cluster, "FEW", few)
        assert {r.node: r.representative for r in cluster.star_clusters(edges(spark, pairs), most_rounds=2).collect()} == stars(pairs)


def test_stars_are_not_transitive(spark):
    run = lambda p: {r.node: r.representative for r in cluster.star_clusters(edges(spark, p)).collect()}
    assert run([(1, 2), (2, 3)]) == {1: 1, 2: 1}
    assert run([(1, 3), (1, 2), (2, 4)]) == {1: 1, 2: 1, 3: 1}


def test_small_acceptance_set(spark):
    """The published acceptance case: exact groups 2 of 5 members, image pair A1-A2, video pairs V1-V2 and V2-V3."""
    zero, near, ones = [0, 0, 0, 0], [7 << 56, 0, 0, 0], [-1, -1, -1, -1]
    images = bands(spark, [(1, zero, 80, 1920, 1080, 0), (2, near, 90, 1920, 1080, 0), (3, near, 30, 1920, 1080, 0), (4, near, 80, 1440, 1080, 0), (5, ones, 99, 1920, 1080, 0)])
    assert [(r.left, r.right) for r in joins.screened_images(images).collect()] == [(1, 2)]
    aa, five = [-0x5555555555555556] * 4, [0x5555555555555555] * 4
    videos = bands(spark, [(1, aa, 70, 1, 1, 60000), (2, [aa[0] ^ 1, *aa[1:]], 70, 1, 1, 61500), (3, [aa[0] ^ 1, *aa[1:]], 70, 1, 1, 62600), (4, five, 70, 1, 1, 60000)])
    assert sorted((r.left, r.right) for r in joins.screened_videos(videos).collect()) == [(1, 2), (2, 3)]
    shas = ["A1", "A2", "A2", "A3", "A4", "A5", "V1", "V2", "V3", "V4", "E", "E", "E"]
    exact = spark.createDataFrame(list(enumerate(shas)), "id long, sha string").groupBy("sha").count().where("count > 1").collect()
    assert sorted((r.sha, r["count"]) for r in exact) == [("A2", 2), ("E", 3)]


@pytest.mark.parametrize("n_near, cosine, want", [(8, 1.0, "yes"), (7, 1.0, "no"), (8, 0.0, "no"), (9, None, "inconclusive"), (None, 1.0, "inconclusive"), (7, None, "no")])
def test_image_stage2(spark, n_near, cosine, want):
    a, b = [0] * 9, [1023] * (n_near or 0) + [2047] * (9 - (n_near or 0))
    hist = {1.0: [1.0, 0.0], 0.0: [0.0, 1.0], None: None}
    df = spark.createDataFrame([(a, b if n_near is not None else None, [1.0, 0.0], hist[cosine])], "a array<long>, b array<long>, c array<float>, d array<float>")
    assert df.select(scoring.image_stage2(*map(F.col, "abcd")).alias("v")).first().v == want
    joint = {"yes": "passed", "no": "rejected", "inconclusive": "incomplete"}[want] if not (n_near == 7 and cosine is None) else "incomplete"
    assert df.select(scoring.image_stage2_r(*map(F.col, "abcd")).alias("v")).first().v == joint


@pytest.mark.parametrize(
    "similarities, g, r, mean",
    [([1.0] * 3, "inconclusive", "inconclusive", None), ([0.9] * 4, "yes", "yes", 0.9), ([0.7, 0.7, 0.7, 0.7, 0.0, 0.0], "yes", "no", 2.8 / 6), ([1.0, 1.0, 1.0, 0.0, 0.0], "no", "no", 0.6), ([0.8] * 4 + [None], "yes", "yes", 0.8)],
)
def test_video_verdicts(spark, similarities, g, r, mean):
    rows = [(1, 2, x or 0.0, x is not None) for x in similarities]
    df = spark.createDataFrame(rows, "left long, right long, similarity double, valid boolean")
    for t, want in ((G, g), (R, r)):
        row = scoring.video_verdict(df, t=t).first()
        assert row.verdict == want and (row.mean == pytest.approx(mean) if mean is not None else row.mean is None)


def test_video_joint_and_stage2(spark):
    def slots(*given):  # (near parts, cosine or None where the histogram is missing, valid)
        hist = {1.0: [1.0, 0.0], 0.6: [0.6, 0.8], 0.0: [0.0, 1.0], None: None}
        return [(1, 2, i, [0] * 9, [0] * n + [-1] * (9 - n), [1.0, 0.0], hist[c], v) for i, (n, c, v) in enumerate(given)]

    schema = "left long, right long, slot int, l_parts array<long>, r_parts array<long>, l_hist array<float>, r_hist array<float>, valid boolean"
    run = lambda f, *given: f(spark.createDataFrame(slots(*given), schema)).first()
    good, far, low, lacking = (8, 1.0, True), (7, 1.0, True), (9, 0.6, True), (9, None, True)
    row = run(scoring.video_joint, *[good] * 3, far, low, (9, 1.0, False))  # far counts 0, low counts 0.6 but hasn't passed
    assert (row.n_valid, row.n_passed, row.verdict) == (5, 3, "no") and row.mean == pytest.approx(3.6 / 5)
    assert run(scoring.video_joint, *[good] * 4, far, far).verdict == "yes"  # by count
    assert run(scoring.video_joint, *[good] * 3, (9, 1.0, False)).verdict == "inconclusive"
    row = run(scoring.video_stage2_r, *[good] * 3, low)
    assert row.verdict == "passed" and row.mean == pytest.approx(0.9)
    assert run(scoring.video_stage2_r, *[good] * 4, far, far).verdict == "rejected"
    assert run(scoring.video_stage2_r, *[good] * 5, lacking).verdict == "incomplete"
    assert run(scoring.video_stage2_r, *[good] * 5, (9, None, False)).verdict == "passed"
    assert run(scoring.video_stage2_r, *[good] * 3).verdict == "incomplete"


def test_thresholds_are_checked():
    for bad in ({"hamming": 257}, {"aspect": -0.1}, {"window_ms": -1}, {"parts": 0}, {"video_frames": 7}):
        with pytest.raises(ValueError):
            Thresholds(**bad)


MEMBERS = "group_id string, kind string, rep_id long, file_id long, machine_id string, path string, size long, mtime long, review string, quality long"


def members(spark):
    rows = [
        ("g", "exact", 99, 1, "m2", "a", 10, 5, "keep", 1),
        ("g", "exact", 99, 2, "m1", "b/long", 30, 9, "delete", 7),
        ("g", "exact", 99, 3, "m1", "a", 20, 1, "delete", 7),
        ("h", "exact", 5, 4, "m1", "c", 10, 1, "delete", 2),
        ("h", "exact", 5, 5, "m9", "d", 10, 2, "delete", 3),
    ]
    return spark.createDataFrame(rows, MEMBERS)


def test_representatives_and_strategies(spark):
    m = members(spark)
    assert {r.group_id: r.rep_file_id for r in groups.representatives(m).collect()} == {"g": 3, "h": 5}
    picked = {s: sorted(r.file_id for r in groups.selection(m, s).collect()) for s in groups.STRATEGIES}
    assert picked == {"newest": [1, 4], "oldest": [1, 2], "largest": [1], "shortest_path": [2]}
    for s in groups.STRATEGIES:
        assert not {3, 5} & set(picked[s])
    assert sorted(r.file_id for r in groups.delete_plan(m).collect()) == [2]
    left = groups.after_delete(m, m.where("file_id in (3, 4)")).collect()
    assert {(r.group_id, r.file_id, r.rep_id) for r in left} == {("g", 1, 1), ("g", 2, 1)}


def test_pages_and_cursors(spark):
    rows = spark.range(25).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    got, cursor = [], None
    while True:
        page = groups.after(rows, ["a", "b"], cursor, 4).collect()
        got += [(r.a, r.b) for r in page[:4]]
        if len(page) <= 4:
            break
        cursor = groups.decode_cursor(groups.encode_cursor((page[3].a, page[3].b)))
    assert got == sorted((i % 3, i) for i in range(25))
    with pytest.raises(ValueError):
        groups.page(rows, [F.col("b")], 1, 501)


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, 5, True, None), (2, 7, False, 3)], "k long, size long, ok boolean, q int")
    new = spark.createDataFrame([(1, 0, False, 101), (3, 4, True, 50)], "k long, size long, ok boolean, q int")
    rules = {"size": "positive", "ok": "sticky", "q": "quality"}
    once = merge.merged(old, new, ["k"], rules)
    assert sorted(map(tuple, once.collect())) == [(1, 5, True, None), (2, 7, False, 3), (3, 4, True, 50)]
    assert sorted(map(tuple, merge.merged(once, new, ["k"], rules).collect())) == sorted(map(tuple, once.collect()))


def test_conflicting_scores_are_errors(spark):
    a, b = (spark.createDataFrame([(1, x)], "k long, doc string") for x in "xy")
    assert merge.scores_kept(a, a, ["k"], "doc").first().doc == "x"
    with pytest.raises(Exception, match="differs"):
        merge.scores_kept(a, b, ["k"], "doc").collect()


def test_histogram_and_percentiles(spark):
    values = [0, 100, 101, 999, 10**9, -1, None, 600_000_001]
    h = stats.histogram(spark.createDataFrame([("x", v) for v in values], "k string, us long"), ["k"], "us")
    assert {r.bucket: r.n for r in h.collect()} == {0: 2, 1: 1, 3: 1, 21: 2}
    assert stats.percentile(h, ["k"], 0.5).first().upper_us == 250 and stats.percentile(h, ["k"], 1.0).first().upper_us == 600_000_000
    rng = random.Random(1)
    for n in (1, 19, 20, 101):
        own = [rng.randrange(50) for _ in range(n)]
        got = stats.nearest_rank_95(spark.createDataFrame([("x", v) for v in own], "k string, v long"), ["k"], "v").first().p95
        assert got == sorted(own)[(95 * n + 99) // 100 - 1]
