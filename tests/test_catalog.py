"""The queries against the SQL that checks them, on a small data set."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value.item() if hasattr(value, "item") else value)


@needs_data
def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as e
    from gemello.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = sorted(catalog.ORACLES)
    assert len(names) > 120
    for name in names[::4]:  # the driver compares all of them; a quarter keeps this quick
        df = e.queries()[name](spark, SF)
        cur = con.execute(e.oracle_sql()[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns), name
        want = sorted([shown(row[columns.index(c)]) for c in df.columns] for row in cur.fetchall())
        assert sorted([shown(v) for v in row] for row in df.collect()) == want, name


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_only_the_entry_module_knows_the_guard():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1]
    for path in (root / "gemello").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "gemello.llm" not in path.read_text(), path


SF_MORE = "/root/testdata/sf0.01"


@needs_data
def test_queries_on_a_larger_set(spark):
    import duckdb

    import __spark_entry__ as e
    from gemello.plans import catalog, extra, runs

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MORE}/{t}.parquet'")
    whole = ["s27_event_batch", "c14_confirmed_groups", "j21_delete_request", "c25_delete_prepare", "s16_ordered_lookup", "s23_ordered_candidates", "s28_container_metadata", "t05_generation_race", "k20_soft_delete", "t08_fair_batch"]
    for name in [*whole, *extra.CATALOG, *runs.CATALOG]:
        df = e.queries()[name](spark, SF_MORE)
        cur = con.execute(catalog.ORACLES[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns), name
        want = sorted([shown(row[columns.index(c)]) for c in df.columns] for row in cur.fetchall())
        got = df.collect()
        assert got and sorted([shown(v) for v in row] for row in got) == want, name


def test_numbered_takes_all_keys(spark):
    from pyspark.sql import functions as F

    from gemello.operators import joins

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000 * 3).alias("key"))
    assert sorted((r.pos, r.key) for r in joins.numbered(rows, "key").collect()) == [(i, 3 * i) for i in range(1000)]
    assert joins.numbered(rows.limit(0), "key").count() == 0
