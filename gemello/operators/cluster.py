"""Clusters of confirmed pairs: connected components (transitive) and stars around representatives (not transitive)."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: So many free nodes and edges of stars the driver may finish.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/checkpoints"
    return f"{where}/gemello-{uuid.uuid4().hex}"


def shared_dir(df: DataFrame) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; /tmp only where all run on one machine."""
    return shared_folder(df.sparkSession)


def written(df: DataFrame, where: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and outlives executors."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def connected_components(edges: DataFrame, left: str = "left", right: str = "right", most_rounds: int = 100) -> DataFrame:
    """node and component, the smallest node it is linked with, by large and small stars in turn (Kiveris et al. 2014).

    Direction, repeats and self-edges don't matter; nodes without edges to others don't appear. Each round is a few
    equi-joins and partial aggregations, so that hubs don't gather their neighbours in one place.
    """
    where = shared_dir(edges)
    now = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    now = written(now, f"{where}/0")
    sign = None
    for step in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low).distinct(), f"{where}/{step}")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sign:
            roots = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
        sign = new
    raise RuntimeError("components didn't converge")


def star_clusters(edges: DataFrame, left: str = "left", right: str = "right", most_rounds: int = 100) -> DataFrame:
    """node and representative: scanning nodes upwards, each free node takes all free direct neighbours.

    The representatives are the lexicographically first maximal independent set, found in rounds: a free node whose
    smaller neighbours are all decided against becomes one, and its larger neighbours are decided against. Members join
    their smallest adjacent representative; representatives without members are dropped. A long chain decides about two
    nodes a round: after most_rounds, once nodes and edges that are still free are at most FEW, the driver scans them;
    while there are more, rounds go on (each decides at least one node).
    """
    where = shared_dir(edges)
    e = edges.where(F.col(left) != F.col(right)).select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi")).distinct()
    e = written(e, f"{where}/edges")
    free = written(e.select(F.col("lo").alias("node")).union(e.select("hi")).distinct(), f"{where}/free0")
    chosen = None
    for step in itertools.count(1):
        blocked = e.join(free.select(F.col("node").alias("lo")), "lo").select(F.col("hi").alias("node")).distinct()
        new = written(free.join(blocked, "node", "left_anti"), f"{where}/new{step}")
        chosen = new if chosen is None else chosen.union(new)
        out = e.join(new.select(F.col("node").alias("lo")), "lo").select(F.col("hi").alias("node")).distinct()
        free = written(free.join(new, "node", "left_anti").join(out, "node", "left_anti"), f"{where}/free{step}")
        if free.limit(1).count() == 0:
            break
        if step >= most_rounds and free.count() <= FEW:
            rest = e.join(free.select(F.col("node").alias("lo")), "lo", "left_semi").join(free.select(F.col("node").alias("hi")), "hi", "left_semi")
            if rest.count() <= FEW:
                near: dict = {}
                for r in rest.collect():
                    near.setdefault(r["lo"], []).append(r["hi"])
                taken, out_of = [], set()
                for node in sorted(r["node"] for r in free.collect()):
                    if node not in out_of:
                        taken.append((node,))
                        out_of.update(near.get(node, []))
                chosen = chosen.union(e.sparkSession.createDataFrame(taken, free.schema))
                break
    reps = chosen.select(F.col("node").alias("lo"))
    joined = e.join(reps, "lo").groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("representative"))
    joined = joined.join(chosen, "node", "left_anti")
    own = joined.select(F.col("representative").alias("node"), "representative").distinct()
    return joined.union(own)


def best_edge(edges: DataFrame, score: str) -> DataFrame:
    """For each node its best edge: the largest score, ties by the smallest pair; columns node, left, right and the score."""
    ends = edges.select(F.explode(F.array("left", "right")).alias("node"), "left", "right", score)
    first = F.struct((-F.col(score)).alias("s"), "left", "right")
    best = ends.groupBy("node").agg(F.min(first).alias("b"))
    return best.select("node", F.col("b.left").alias("left"), F.col("b.right").alias("right"), (-F.col("b.s")).alias(score))


def confirmed_groups(components: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """Members of components with live copies: contents without one drop out, and groups of fewer than two contents."""
    live = files.where(F.col("status") != "deleted")
    rows = components.join(live, F.col("node") == F.col(content))
    big = rows.groupBy("component").agg(F.count_distinct("node").alias("n_contents")).where("n_contents >= 2").select("component")
    return rows.join(big, "component", "left_semi")


def group_id(*parts) -> Column:
    """A stable id of what makes up a group."""
    return F.concat(F.lit("local-"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32))
