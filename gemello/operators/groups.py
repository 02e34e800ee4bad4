"""Analytics over groups and their members: summaries, representatives, strategies, pages, reviews and delete plans.

`members` has group_id, kind, rep_id and the columns of live files; `rep_id` is the stored representative, which may
not be live any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = {
    "newest": [F.desc, "mtime"],
    "oldest": [F.asc, "mtime"],
    "largest": [F.desc, "size"],
    "shortest_path": [F.asc, "length"],
}


def _rep_order() -> list[Column]:
    return [(F.col("file_id") != F.col("rep_id")).cast("int"), F.col("machine_id"), F.col("path"), F.col("file_id")]


def ranked(members: DataFrame) -> DataFrame:
    """members with rep_rank: 1 is the effective representative, the stored one if live, else the first by machine, path and id."""
    return members.withColumn("rep_rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*_rep_order())))


def representatives(members: DataFrame) -> DataFrame:
    """group_id and the effective representative's columns, in one aggregation."""
    first = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_rep_order())])
    return members.groupBy("group_id").agg(F.min_by(F.struct("file_id", "machine_id", "path", "size"), first).alias("r")).select("group_id", *[F.col(f"r.{c}").alias(f"rep_{c}") for c in ("file_id", "machine_id", "path", "size")])


def summary(members: DataFrame) -> DataFrame:
    """Members, bytes, reclaimable bytes (all but the largest) and the sorted machines of each group."""
    own = members.groupBy("group_id", "kind").agg(F.count(F.lit(1)).alias("n_members"), F.sum("size").alias("total_bytes"), F.greatest(F.sum("size") - F.max("size"), F.lit(0)).alias("reclaim_bytes"), F.sort_array(F.collect_set("machine_id")).alias("machines"))
    return own


def stats(members: DataFrame) -> DataFrame:
    g = summary(members)
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_members"), F.lit(0)).alias("n_members"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("reclaim_bytes"), F.lit(0)).alias("reclaim_bytes"))


def summary_by_rep(members: DataFrame) -> DataFrame:
    """Reclaimable bytes as all but the representative's, which is the first by stored representative, machine and path."""
    first = F.struct((F.col("file_id") != F.col("rep_id")).cast("int").alias("o"), "machine_id", "path", "file_id")
    rep = F.min_by(F.struct("size", "path"), first)
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"), (F.sum("size") - rep["size"]).alias("reclaim_bytes"), rep["path"].alias("rep_path"))


def conditional_summary(members: DataFrame) -> DataFrame:
    """The same over ranks: what isn't first can go."""
    r = ranked(members)
    return r.groupBy("group_id").agg(F.sum(F.when(F.col("rep_rank") != 1, F.col("size")).otherwise(0)).alias("reclaim_bytes"), F.max(F.when(F.col("rep_rank") == 1, F.col("path"))).alias("rep_path"))


def matching(members: DataFrame, condition: Column, least_members: int = 1, kinds: list[str] | None = None) -> DataFrame:
    """All members of groups in which any live member meets a condition."""
    m = members.where(F.col("kind").isin(kinds)) if kinds else members
    hit = m.where(condition).select("group_id").distinct()
    big = m.groupBy("group_id").count().where(F.col("count") >= least_members).select("group_id")
    return m.join(hit, "group_id", "left_semi").join(big, "group_id", "left_semi")


def review_state(members: DataFrame) -> DataFrame:
    """Of each group, whether all members are reviewed, and how many are kept, deleted and undecided."""
    n = lambda v: F.sum(F.when(F.col("review") == v, 1).otherwise(0)).alias(f"n_{v}")
    return members.groupBy("group_id").agg(F.bool_and(F.col("review") != "undecided").alias("reviewed"), n("keep"), n("delete"), n("undecided"))


def keep_order(strategy: str) -> list[Column]:
    way, what = STRATEGIES[strategy]
    return [way(F.length("path") if what == "length" else F.col(what)), F.col("file_id")]


def selection(members: DataFrame, strategy: str) -> DataFrame:
    """Files that a strategy selects for deletion: neither the effective representative nor the strategy's keeper of a group."""
    r = ranked(members).withColumn("keep_rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*keep_order(strategy))))
    return r.where("rep_rank != 1 and keep_rank != 1")


def quick_rule(members: DataFrame, value: Column) -> DataFrame:
    """members with mark: the last member with the largest value (in order of machine and path) is kept, the others go."""
    last = Window.partitionBy("group_id").orderBy(value.desc_nulls_last(), F.col("machine_id").desc(), F.col("path").desc())
    return members.withColumn("mark", F.when(F.row_number().over(last) == 1, "keep").otherwise("delete"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of 1 to 500 rows; each order should end with an id."""
    if not 1 <= size <= 500 or number < 1:
        raise ValueError("a page has 1 to 500 rows and a number from 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after(rows: DataFrame, keys: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """The next `size` + 1 rows after a cursor in lexicographic order of the keys; one more than asked for shows that there are more."""
    if cursor is not None:
        condition = F.lit(False)
        same = F.lit(True)
        for key, value in zip(keys, cursor, strict=True):
            condition = condition | (same & (F.col(key) > F.lit(value)))
            same = same & (F.col(key) == F.lit(value))
        rows = rows.where(condition)
    return rows.orderBy(*keys).limit(size + 1)


def encode_cursor(values: tuple) -> str:
    import base64
    import json

    return base64.urlsafe_b64encode(json.dumps(list(values)).encode()).decode()


def decode_cursor(cursor: str) -> tuple:
    import base64
    import json

    return tuple(json.loads(base64.urlsafe_b64decode(cursor.encode())))


def delete_summary(selected: DataFrame, samples: int = 20) -> DataFrame:
    """Files, bytes, files by machine and the first samples by path of a selection; bounded state for any size."""
    machines = selected.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    by = machines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("machine_id", "n")))).alias("machines"))
    first = selected.select("path").orderBy("path").limit(samples).agg(F.sort_array(F.collect_list("path")).alias("samples"))
    return by.crossJoin(F.broadcast(first))


def delete_plan(members: DataFrame) -> DataFrame:
    """Marked files that can go, by canonical order; groups that would lose their last kept member are left alone."""
    safe = members.where(F.col("review") == "keep").select("group_id").distinct()
    reps = representatives(members).select(F.col("rep_file_id").alias("file_id"))
    marked = members.where(F.col("review") == "delete").join(safe, "group_id", "left_semi")
    return marked.join(reps, "file_id", "left_anti")


def after_delete(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Members that are left once files are deleted: groups below two drop out, and a lost representative is elected anew.

    The new one is the first member marked keep, else the first, by machine and path.
    """
    left = members.join(deleted.select("file_id"), "file_id", "left_anti")
    big = left.groupBy("group_id").count().where("count >= 2").select("group_id")
    left = left.join(big, "group_id", "left_semi")
    first = F.struct((F.col("file_id") != F.col("rep_id")).cast("int").alias("a"), (F.col("review") != "keep").cast("int").alias("b"), "machine_id", "path", "file_id")
    reps = left.groupBy("group_id").agg(F.min_by("file_id", first).alias("new_rep"))
    return left.join(reps, "group_id").withColumn("rep_id", F.col("new_rep")).drop("new_rep")


def shards(items: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """items with shard: consecutive pieces of at most `size` within each value of `by`."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return items.withColumn("shard", F.floor((n - 1) / size))


def fair_order(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with turn: the first of each value of `by`, then the second of each, and so on."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def applied_results(files_: DataFrame, members_: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply delete results (file_id, ok) once: files with their status after it, and the groups' live members after it.

    A file whose deletion succeeded is deleted, one that failed stays as it was. Groups (group_id, n_left, released) lose
    their deleted members; with fewer than two left they are dissolved.
    """
    done = results.where("ok").select("file_id").distinct().withColumn("__gone", F.lit(True))
    after = files_.join(done, "file_id", "left").withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))).drop("__gone")
    own = members_.join(done, "file_id", "left").groupBy("group_id").agg(
        F.sum(F.when(F.col("__gone").isNull(), 1).otherwise(0)).alias("n_left"), F.sum(F.when(F.col("__gone"), F.col("size")).otherwise(0)).alias("released")
    )
    return after, own.withColumn("dissolved", F.col("n_left") < 2)
