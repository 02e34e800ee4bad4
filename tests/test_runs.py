"""Operators of second-stage runs and written tables on small rows, with nulls, ties, repeats and empty tables."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from gemello.operators import cluster, runs
from gemello.operators.config import Thresholds
from gemello.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_recovered_pairs(spark):
    schema = "group_id string, content string, status string, peer string, hamming int, quality_self int, quality_peer int"
    members = [
        ("good", "a", "active", "b", 7, 10, 20),
        ("good", "b", "active", "a", 7, 20, 10),
        ("good", "b", "active", None, None, None, None),
        ("bare", "a", "active", None, None, None, None),
        ("bare", "b", "active", None, None, None, None),
        ("conflict", "a", "active", "b", 7, 10, 20),
        ("conflict", "b", "active", "a", 8, 20, 10),
        ("outside", "a", "active", "z", 7, 10, 20),
        ("outside", "b", "active", None, None, None, None),
        ("range", "a", "active", "b", 257, 10, 20),
        ("range", "b", "active", None, None, None, None),
        ("three", "a", "active", None, None, None, None),
        ("three", "b", "active", None, None, None, None),
        ("three", "c", "active", None, None, None, None),
        ("dead", "a", "active", None, None, None, None),
        ("dead", "b", "deleted", None, None, None, None),
    ]
    df = spark.createDataFrame(members, schema)
    got = {r.group_id: r for r in runs.recovered_pairs(df).collect()}
    assert set(got) == {"good", "bare", "conflict", "outside", "range"}
    assert tuple(got["good"])[1:] == ("a", "b", 7, 10, 20, None)
    assert tuple(got["bare"])[1:] == ("a", "b", None, None, None, None)
    assert [got[k].problem for k in ("conflict", "outside", "range")] == ["conflict", "outside", "range"]
    assert runs.recovered_pairs(df.limit(0)).count() == 0


def test_recovered_traces_match_sql_where_a_third_content_meets_a_deleted_end(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    path = f"{tmp_path}/embeddings.parquet"
    spark.range(140).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding")).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(e.oracle_sql()["c16_recovered_traces"]).fetchall(), key=repr)
    got = rows(e.queries()["c16_recovered_traces"](spark, str(tmp_path)))
    assert len(want) > 100
    assert got == want


def test_rescoring_waits_for_features_and_ends_at_the_barrier(spark):
    t = Thresholds(part_bits=0, parts=2, sobel=0.9)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (1, 2)], "left long, right long")
    schema = "content long, parts array<long>, hist array<double>"
    first = spark.createDataFrame([(1, [1, 2], [1.0, 0.0]), (2, [1, 2], [1.0, 0.0]), (3, [1, 2], None)], schema)
    second = spark.createDataFrame([(3, None, [0.0, 1.0])], schema)
    none = first.limit(0)
    got = rows(runs.rescored(pairs, [first, none, second], t))
    assert got == [(1, 2, "yes", 0), (1, 3, "no", 2), (1, 4, "inconclusive", 3), (2, 3, "no", 2)]
    assert rows(runs.rescored(pairs.limit(0), [first], t)) == []
    assert {r.verdict for r in runs.rescored(pairs, [], t).collect()} == {"inconclusive"}


def test_stage2_plan_against_slots(spark):
    cases = list(itertools.product(("video", "image", "other", None), (None, 0, 3, 7), (None, 0, 5), (None, 0, 6)))
    sources = [(i, kind, 1 if kind == "image" else 7) for i, (kind, *_) in enumerate(cases)]
    local = [(i, True, stage1, here) for i, (_, stage1, here, _) in enumerate(cases) if i % 11]
    remote = [(i, there) for i, (*_, there) in enumerate(cases) if i % 7]
    want = []
    for i, (kind, stage1, here, there) in enumerate(cases):
        have = (stage1 or 0) & (1 if kind == "image" else 7)
        if i % 11 == 0 or kind not in ("image", "video") or not have:
            want.append((i, "incomplete_base", 0))
            continue
        masks = {"republish": 0, "import": 0, "compute": 0}
        for slot in range(3):
            if have >> slot & 1:
                action = "republish" if (here or 0) >> slot & 1 else "import" if i % 7 and (there or 0) >> slot & 1 else "compute"
                masks[action] |= 1 << slot
        want += [(i, a, m) for a, m in masks.items() if m]
    got = runs.stage2_plan(
        spark.createDataFrame(sources, "content long, kind string, slots int"),
        spark.createDataFrame(local, "content long, base_complete boolean, stage1 int, stage2 int"),
        spark.createDataFrame(remote, "content long, stage2 int"),
    )
    assert rows(got) == sorted(want, key=repr)
    twice = spark.createDataFrame([(1,), (1,), (2,)], "content long")
    assert rows(runs.duplicate_sources(twice)) == [(1, 2)]


def test_single_flight_owners_fail_and_waiters_retry(spark):
    requests = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "k", True), (4, "bad", False), (5, "c", True), (6, "k", None)], "job long, content string, ok boolean")
    cached = spark.createDataFrame([("c",), ("c",)], "content string")
    want = [(1, "k", "failed", None), (2, "k", "owner", 2), (3, "k", "reused", 2), (4, "bad", "failed", None), (5, "c", "cached", None), (6, "k", "reused", 2)]
    assert rows(runs.single_flight(requests, cached, ["content"])) == sorted(want, key=repr)


def test_revision_gate(spark):
    r = spark.createDataFrame([(1, "l", 5, 9, [9]), (2, "l", 4, 9, [9]), (3, "l", 5, 9, [9, 8]), (4, "l", 5, 9, None), (5, "gone", 5, 9, [9])], "run long, library string, revision long, task long, selected array<long>")
    now = spark.createDataFrame([("l", 5)], "library string, revision long")
    assert {x.run: x.state for x in runs.revision_gate(r, now).collect()} == {1: "valid", 2: "revision_changed", 3: "task_mismatch", 4: "task_mismatch", 5: "revision_changed"}


def test_reports_after_the_deadline_are_dropped(spark):
    items = spark.createDataFrame([("t", i, 10) for i in range(4)] + [("u", 9, 99)], "task string, item long, deadline long")
    reports = spark.createDataFrame([(0, 5, True), (0, 6, False), (1, 10, False), (2, 11, True), (7, 1, True)], "item long, at long, ok boolean")
    want = [("t", 1, 3, 2, 0, 1, True), ("u", 0, 0, 0, 1, 0, False)]
    assert rows(runs.finalised(items, reports, F.lit(10))) == want
    assert rows(runs.finalised(items, reports, F.lit(9)))[0] == ("t", 1, 1, 0, 2, 1, False)


def test_batches_apply_contents_first_and_ignore_tombstones(spark):
    batch = spark.createDataFrame(
        [(1, "m", "file", "c", "p", True), (2, "m", "content", "c", None, None), (3, "m", "tombstone", "c", "p", False), (4, "m", "file", "x", "q", True), (5, "n", "tombstone", "c", "p", False)],
        "seq long, machine string, record string, content string, path string, active boolean",
    )
    contents = spark.createDataFrame([("d", 0)], "content string, seq long")
    files = spark.createDataFrame([("m", "p", "d", False, 0)], "machine string, path string, content string, active boolean, seq long")
    cursors = spark.createDataFrame([("m", 2), ("n", 9)], "machine string, committed long")
    known, state, ends, orphans = runs.applied_batch(contents, files, cursors, batch)
    assert rows(known) == [("c", 2), ("d", 0)]
    assert rows(state) == [("m", "p", "c", True, 1)]
    assert rows(ends) == [("m", 4), ("n", 9)]
    assert [r.seq for r in orphans.collect()] == [4]
    again = runs.applied_batch(known, state, ends, batch)
    assert rows(again[1]) == rows(state) and rows(again[2]) == rows(ends)


def test_outbox_keeps_what_is_there(spark):
    schema = "topic string, entity string, generation long, payload string, at long"
    there = spark.createDataFrame([("t", "e", 1, "{}", 9)], schema)
    events = spark.createDataFrame([("t", "e", 1, "[1]", 1), ("t", "e", 2, "2", 5), ("t", "e", 2, "3", 4), ("", "e", 1, "{}", 1), ("t", "e", -1, "{}", 1), ("t", "f", 1, "{x", 1), ("t", "f", 1, None, 1)], schema)
    kept, refused = runs.enqueued(there, events)
    assert rows(kept) == [("t", "e", 1, "{}", 9), ("t", "e", 2, "3", 4)]
    assert refused.count() == 4
    poison = spark.createDataFrame([("t", "e", 1)], "topic string, entity string, generation long")
    assert [r.generation for r in runs.pruned(kept, poison, ["topic", "entity"], "generation").collect()] == [2]


def test_reviews_need_a_member(spark):
    groups = spark.createDataFrame([("g",)], "group_id string")
    members = spark.createDataFrame([("g", 1), ("g", 2)], "group_id string, file_id long")
    unsure = spark.createDataFrame([("i", 7, 8), ("j", 7, 9)], "group_id string, left long, right long")
    reviews = spark.createDataFrame([("g", 1, "keep", 1), ("g", 1, "delete", 2), ("g", 3, "keep", 1), ("g", 2, "burn", 1), ("i", 8, "delete", 1), ("none", 1, "keep", 1), ("g", 2, None, 1)], "group_id string, file_id long, mark string, at long")
    accepted, made, refused = runs.committed_reviews(groups, members, unsure, reviews)
    assert rows(accepted) == [("g", 1, "delete"), ("i", 8, "delete")]
    assert rows(made) == [("i", 7), ("i", 8)]
    assert refused.count() == 4


def test_written_tables(spark):
    one = spark.createDataFrame([(1,), (2,)], "a long")
    where = cluster.shared_folder(spark)
    assert rows(tables.frozen(one, where)) == rows(tables.frozen(one.where("a = 1"), where)) == [(1,), (2,)]
    local = where.removeprefix("file://")
    os.remove(f"{local}/_SUCCESS")  # as if the first attempt had been cut off
    assert rows(tables.frozen(one.where("a = 1"), where)) == [(1,)]

    t = tables.ClassTable(spark, cluster.shared_folder(spark), "run", one.schema)
    for run in ("x/y", "ü"):
        t.replace(run, one)
    t.replace("x/y", one.limit(0))
    assert t.read("x/y").count() == 0 and rows(t.read("ü")) == [(1, "ü"), (2, "ü")] and t.read("never").count() == 0

    g = tables.Generations(spark, cluster.shared_folder(spark), one.schema)
    assert g.current().count() == 0
    assert [g.publish(one), g.publish(one.where("a = 2"))] == [1, 2]
    assert rows(g.current()) == [(2, 2)]


def test_masks_and_complete_videos(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int").select(runs.missing_mask(["a", "b"]).alias("m"))
    assert sorted(r.m for r in df.collect()) == [2, 3]
    slots = [(1, s, s < 4, True) for s in range(6)] + [(2, s, True, s > 0) for s in range(6)] + [(3, s, True, True) for s in range(5)] + [(4, s, s < 3, True) for s in range(6)]
    df = spark.createDataFrame(slots, "video_id long, slot int, decoded boolean, stage2 boolean")
    assert rows(runs.complete_videos(df)) == [(1, 4)]


def test_receipt_of_deleted_tasks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "task long, v string")
    left, receipt = runs.without_tasks({"a": a, "b": a.limit(0)}, spark.createDataFrame([(1,), (1,), (5,)], "task long"))
    assert rows(left["a"]) == [(2, "z")] and rows(receipt) == [(1, "a", 2)]


@pytest.mark.parametrize("final", [False, True])
def test_ready_scores_of_empty_tables(spark, final):
    pairs = spark.createDataFrame([], "left long, right long")
    features = spark.createDataFrame([], "content long, parts array<long>, hist array<double>")
    assert runs.ready_scores(pairs, features, final).count() == 0
