import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gemello.llm import minhash_dedup as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(rows, k, percent):
    """doc_id -> smallest doc_id that links lead to; rows of (doc_id, text)."""
    sets = [(d, brute_set(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def near_copies(seed, groups=6, size=25, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, k, percent, schema="doc_id long, text string"):
    return m.deduplicated(spark.createDataFrame(rows, schema), k, percent).collect()


def test_against_brute_force(spark):
    for seed, k in ((1, 2), (2, 5)):
        rows = near_copies(seed)
        want = brute(rows, k, 80)
        got = run(spark, rows, k, 80)
        assert {r.doc_id: r.component_id for r in got} == want
        texts = dict(rows)
        assert all(r.n_shingles == len(brute_set(texts[r.doc_id], k)) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_and_one_large_group(spark):
    """A chain whose ends aren't alike, copies beyond a tile, and an outlier that shares their words without a link."""
    words = [f"c{i}" for i in range(100)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 40])) for i in range(15)]
    base = [f"b{i}" for i in range(50)]
    copies = [(100 + i, " ".join([*base, f"u{i}", f"v{i}"])) for i in range(600)]
    apart = [(1000 + i, " ".join([*base[:42], *[f"o{i}-{j}" for j in range(12)]])) for i in range(40)]
    rows = chain + copies + apart
    want = brute(rows, 2, 80)
    got = {r.doc_id: r.component_id for r in run(spark, rows, 2, 80)}
    assert got == want and got[699] == 100


def test_defined_results(spark):
    rows = [(3, "a b c", "x", 1), (1, "A B\tC", "x", 1), (1, "A B\tC", "x", 1), (4, None, "x", 1), (5, "", "x", 1), (6, " \n", "x", 1), (7, "one", "x", 1), (8, "ONE", "x", 1), (None, "a b c", "x", 1), (None, None, "x", 1), (9, "É b", "x", 1), (10, "é b", "x", 1)]
    got = run(spark, rows, 2, 80, "doc_id long, text string, component_id string, key int")
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by == {1: (2, 1, True), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (1, 7, True), 8: (1, 7, False), 9: (1, 9, True), 10: (1, 10, True)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert run(spark, [], 2, 80) == []


def test_estimates_and_reach():
    rng = np.random.default_rng(5)
    common, rest = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.sort(np.concatenate([common, rest[:100]])), np.sort(np.concatenate([common, rest[100:]]))]
    sig = m.packed(m.minima(sets))
    assert abs(float(m.estimated(sig[0], sig[1])) - 0.8) < 0.12 and float(m.estimated(sig[0], sig[0])) == 1
    assert 0.6 < m.reach(80) < 0.75


def test_long_texts_and_shingles():
    text = " ".join(f"x{i % 900}" for i in range(30000))
    (got,) = m.shingles(pa.array([text]), 2)
    assert len(got) == len(brute_set(text, 2))
    a, b = m.shingles(pa.array(["p q r", "q r"]), 5)
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_words_that_polynomial_hashes_confuse():
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    texts = [f"p {x} q {y} r {x} {y}", f"p {y} q {x} r {y} {x}", x, y, "z" * 70000]
    for size in (2, 5):
        assert [len(s) for s in m.shingles(pa.array(texts), size)] == [len(brute_set(t, size)) for t in texts]
    a, b, c, d, _ = m.shingles(pa.array(texts), 2)
    assert len(np.intersect1d(a, b)) == len(brute_set(texts[0], 2) & brute_set(texts[1], 2)) and c[0] != d[0]


def test_joins_with_and_without_heavy_keys(spark):
    for skewed in (False, True):
        rows = [(k % 3000, k) for k in range(9000)] + [(7, 10_000 + k) for k in range(500 * skewed)]
        left = spark.createDataFrame(rows, "k long, x long")
        counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        got = m.spread(left, spark.createDataFrame([(k, -k) for k in range(2, 4000)], "k long, y long"), "k", counts)
        assert ("__salt" in got._jdf.queryExecution().analyzed().toString()) == skewed
        assert sorted(map(tuple, got.collect())) == sorted((k, x, -k) for k, x in rows if k >= 2)


def test_plans_name_each_lineage_once(spark, monkeypatch):
    """Copies of a lineage in a plan took more than the driver's memory allows."""
    plans, write = [], m.written

    def seen(df, where):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df, where)

    monkeypatch.setattr(m, "written", seen)
    df = spark.createDataFrame(near_copies(3), "doc_id long, text string")
    out = m.deduplicated(df, 2, 80)
    plans.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    assert max(plans) <= 60 and sum(plans) <= 200, plans
