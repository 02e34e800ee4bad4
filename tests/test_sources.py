import hashlib

from gemello.sources import schemas, walk


def test_walk(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.JPG").write_bytes(b"x")
    (tmp_path / "a/b/two.mkv").write_bytes(b"yy")
    (tmp_path / "a/b/three.txt").write_bytes(b"zzz")
    (tmp_path / "a/empty.txt").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in walk.walk(spark, [f"{tmp_path}/a", f"{tmp_path}/a/b"], digests=True).collect()}
    assert {k: (r.size, r.kind) for k, r in rows.items()} == {"one.JPG": (1, "image"), "two.mkv": (2, "video"), "three.txt": (3, "other")}
    assert rows["two.mkv"].sha512 == hashlib.sha512(b"yy").hexdigest() and rows["one.JPG"].md5 == hashlib.md5(b"x").hexdigest()
    some = walk.walk(spark, [f"{tmp_path}/a"], [".jpg", ".MKV"])
    assert some.count() == 2 and "content" not in some.columns


def test_schemas(spark):
    t = schemas.tables()["files"]
    rows = [(1, "m", 0, "p", 5, 1, "a" * 128, "active", 0), (2, "m", 0, "q", -1, 1, "A" * 128, "gone", 0), (3, "m", 0, "r", None, 1, None, "deleted", 0)]
    good, bad = schemas.split(spark.createDataFrame(rows, t.schema), t)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.violations for r in bad.collect()} == {2: ["sha512", "size", "status"], 3: ["size"]}
    assert all(set(x.key) <= set(x.schema.names) for x in schemas.tables().values())
