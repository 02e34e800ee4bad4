"""Incremental synchronisation of change logs with Structured Streaming.

Delivery is at least once and every merge is idempotent: within a micro-batch the latest generation of a key wins, and
against the table a generation only replaces an older one. Tables are folders of versions: a batch writes a new
version and then moves the pointer, so that readers never see half a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(batch: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """The row of the latest generation of each key; equal generations are repeats of one row."""
    w = Window.partitionBy(*keys).orderBy(F.col(generation).desc(), *[F.col(c) for c in sorted(batch.columns)])
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged(table: DataFrame, batch: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """table with a batch: the newer generation of each key stays, whatever the order or number of deliveries."""
    return latest(table.unionByName(batch.select(*table.columns)), keys, generation)


def split_valid(batch: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be applied, and rows for the dead-letter table."""
    ok = F.coalesce(valid, F.lit(False))
    return batch.where(ok), batch.where(~ok)


class VersionedTable:
    """A Parquet table whose versions are folders; a pointer file names the current one. Paths are Hadoop paths."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        found = [-1]
        if self.fs.exists(self._fs_path(self.path)):
            for status in self.fs.listStatus(self._fs_path(self.path)):
                name = status.getPath().getName()
                if name.startswith("current-"):
                    found.append(int(name.removeprefix("current-")))
        return max(found)

    def read(self) -> DataFrame:
        v = self.version()
        if v < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def replace(self, df: DataFrame) -> None:
        """Write the next version and make it current; versions before the last one, which no reader began on, go."""
        now = self.version()
        df.write.mode("overwrite").parquet(f"{self.path}/v{now + 1}")
        self.fs.create(self._fs_path(f"{self.path}/current-{now + 1}"), True).close()
        for old in range(now - 1, -1, -1):
            if not self.fs.delete(self._fs_path(f"{self.path}/v{old}"), True):
                break
            self.fs.delete(self._fs_path(f"{self.path}/current-{old}"), False)


def sync(source: DataFrame, target: VersionedTable, dead: VersionedTable, keys: list[str], generation: str, valid: Column, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """A streaming query that merges a change stream into a table and keeps invalid rows apart.

    Every batch is merged, whatever its number: a repeated one changes nothing, and after a checkpoint is lost or renewed,
    when numbers begin again, none is taken for an old one.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = prepare(batch) if prepare else batch
        good, bad = split_valid(batch, valid)
        target.replace(merged(target.read(), good, keys, generation))
        wrong = bad.select(*dead.schema.fieldNames())
        if not wrong.isEmpty():
            dead.replace(dead.read().unionByName(wrong).distinct())

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(backlog: Column, seconds_since: Column, most: int = 50_000, interval: int = 300) -> Column:
    """Why a synchronisation starts now: "backlog" of `most` rows or more, else the "interval" is over, else null."""
    return F.when(backlog >= most, "backlog").when(seconds_since >= interval, "interval")


def health(passed: Column, failed: Column, pending: Column) -> Column:
    """healthy only after a whole pass, or when there was nothing to do; degraded while rows wait or after a failure."""
    return F.when(failed > 0, "degraded").when((pending == 0) & (passed >= 0), "healthy").otherwise("degraded")


def pulled(cursors: DataFrame, log: DataFrame, pruned_before: int, limit: int = 1000) -> DataFrame:
    """What each consumer (consumer, cursor) gets of a log (consumer, seq): mode, n rows and the cursor to acknowledge.

    A cursor before the pruned part can't be continued: its consumer takes a snapshot and goes on from the log's end.
    Others get the next `limit` rows after their cursor; the acknowledged cursor never goes back.
    """
    end = log.groupBy("consumer").agg(F.max("seq").alias("end"))
    w = Window.partitionBy("consumer").orderBy("seq")
    after = log.join(cursors, "consumer").where((F.col("seq") > F.col("cursor")) & (F.col("cursor") >= pruned_before - 1))
    batch = after.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).groupBy("consumer").agg(F.max("n").cast("long").alias("n"), F.max("seq").alias("last"))
    out = cursors.join(end, "consumer", "left").join(batch, "consumer", "left")
    stale = F.col("cursor") < pruned_before - 1
    return out.select(
        "consumer",
        F.when(stale, "snapshot").otherwise("pull").alias("mode"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.greatest("cursor", F.when(stale, F.col("end")).otherwise(F.coalesce("last", "cursor"))).alias("ack"),
    )


def windows(events: DataFrame, at: str, by: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Event-time counts and sums with a watermark (an addition: the profiles' own windows are over processing time)."""
    out = events.withWatermark(at, late) if events.isStreaming else events
    return out.groupBy(F.window(at, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def fair_batch(queue: DataFrame, table: str, order: list[str], limit: int, first: int = 0, tables: list[str] | None = None) -> DataFrame:
    """The next `limit` rows of a queue, by turns over its tables, which begin with number `first` of them."""
    w = Window.partitionBy(table).orderBy(*order)
    rows = queue.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)  # no task ranks more of a table
    if not tables:
        return rows.orderBy("turn", *order).limit(limit)
    at = F.lit(len(tables))
    for i, name in enumerate(tables):
        at = F.when(F.col(table) == name, (i - first) % len(tables)).otherwise(at)
    return rows.withColumn("at", at).orderBy("turn", "at", *order).limit(limit)
