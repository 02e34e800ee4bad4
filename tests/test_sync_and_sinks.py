import random

import pytest
from pyspark.sql import functions as F

from gemello.sources import tsv
from gemello.streaming import sync

SCHEMA = "entity long, generation long, value string"


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_sync_is_idempotent_and_keeps_invalid_rows_apart(spark, tmp_path):
    batches = [[(1, 1, "a"), (2, 1, "b"), (None, 1, "bad")], [(1, 3, "c"), (2, 1, "b")], [(1, 2, "late"), (3, 1, "d"), (4, 1, None)]]
    source = stream(spark, tmp_path / "in", batches)
    target = sync.VersionedTable(spark, f"{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema)
    dead = sync.VersionedTable(spark, f"{tmp_path}/d", target.schema)
    valid = F.col("entity").isNotNull() & F.col("value").isNotNull()
    for _ in range(2):  # the second run finds nothing new
        sync.sync(source, target, dead, ["entity"], "generation", valid, f"{tmp_path}/c").awaitTermination()
        assert sorted(map(tuple, target.read().collect())) == [(1, 3, "c"), (2, 1, "b"), (3, 1, "d")]
        assert {r.value for r in dead.read().collect()} == {"bad", None}
    # repeated under a new checkpoint, whose batches count from 0 again: nothing is lost or doubled
    before = target.version()
    sync.sync(source, target, dead, ["entity"], "generation", valid, f"{tmp_path}/renewed").awaitTermination()
    assert target.version() > before and sorted(map(tuple, target.read().collect())) == [(1, 3, "c"), (2, 1, "b"), (3, 1, "d")]
    assert {r.value for r in dead.read().collect()} == {"bad", None}


def test_merge_order_does_not_matter(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), g, f"v{g}") for g in range(40)]
    want = None
    for _ in range(3):
        rng.shuffle(rows)
        table = spark.createDataFrame([], SCHEMA)
        for i in range(0, 40, 13):
            table = sync.merged(table, spark.createDataFrame(rows[i : i + 13], SCHEMA), ["entity"], "generation")
        got = sorted(map(tuple, table.collect()))
        assert want in (None, got)
        want = got


def test_streaming_windows_match_batch(spark, tmp_path):
    rows = [(i, i % 2, f"2024-01-01 00:{i % 60:02d}:00") for i in range(90)]
    df = spark.createDataFrame(rows, "v long, k long, t string").selectExpr("v", "k", "timestamp(t) as ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = sync.windows(live, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, sync.windows(df, "ts", "k", "v").collect()))


def test_fair_batches_rotate(spark):
    rows = spark.createDataFrame([(t, i) for t in "abc" for i in range(5)], "t string, n long")
    got = [(r.t, r.n) for r in sync.fair_batch(rows, "t", ["n"], 4, first=1, tables=["a", "b", "c"]).collect()]
    assert got == [("b", 0), ("c", 0), ("a", 0), ("b", 1)]


def test_result_file(spark, tmp_path):
    rows = [("g2", "m", "x\ty"), ("g1", "m", "l1\nl2"), ("g1", None, "z")]
    path = f"{tmp_path}/r.tsv"
    digest = tsv.publish(spark.createDataFrame(rows, "g string, m string, p string"), ["g", "m", "p"], ["g", "p"], path)
    assert len(digest) == 64 and tsv.verify(path) == 3
    assert list(tsv.read_members(path)) == [["g1", "m", "l1\\x0al2"], ["g1", "", "z"], ["g2", "m", "x\\x09y"]]
    text = open(path).read()
    for broken in (text.replace("g2", "g3"), text.rsplit("F\t", 1)[0], text + "M\tq\n"):
        with open(path, "w") as f:
            f.write(broken)
        with pytest.raises(ValueError):
            tsv.verify(path)
