"""Telemetry: fixed-bucket latency histograms that merge, exact nearest-rank percentiles and windowed rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in microseconds; one bucket more takes what lies above.
BOUNDS_US = (100, 250, 500, 1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000, 30_000_000, 60_000_000, 120_000_000, 300_000_000, 600_000_000)


def bucket(value_us: Column) -> Column:
    """The bucket of a duration; negative ones have none."""
    out = F.when(value_us < 0, None)
    for i, bound in enumerate(BOUNDS_US):
        out = out.when(value_us <= bound, i)
    return out.otherwise(F.when(value_us.isNotNull(), len(BOUNDS_US)))


def histogram(rows: DataFrame, by: list[str], value_us: str) -> DataFrame:
    """by, bucket and n: a histogram that merges by adding up."""
    return rows.withColumn("bucket", bucket(F.col(value_us))).where("bucket is not null").groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(histograms: DataFrame, by: list[str]) -> DataFrame:
    return histograms.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentile(histograms: DataFrame, by: list[str], share: float) -> DataFrame:
    """The upper bound of the bucket that holds the ceiling rank; the last bound for what lies above all."""
    share = 0.01 if share <= 0 else min(share, 1.0)
    w = Window.partitionBy(*by)
    rows = histograms.withColumn("seen", F.sum("n").over(w.orderBy("bucket"))).withColumn("count", F.sum("n").over(w))
    first = rows.where(F.col("seen") >= F.floor(F.col("count") * share + 0.999999999)).groupBy(*by).agg(F.min("bucket").alias("b"))
    bounds = F.array(*[F.lit(x).cast("long") for x in BOUNDS_US])
    return first.select(*by, F.element_at(bounds, F.least(F.col("b"), F.lit(len(BOUNDS_US) - 1)) + 1).alias("upper_us"))


def nearest_rank_95(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact value at index (95 n + 99) / 100 of the sorted values, from counts of equal values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    seen = counts.withColumn("seen", F.sum("n").over(w.orderBy(value))).withColumn("count", F.sum("n").over(w))
    return seen.where(F.col("seen") >= F.expr("(95 * count + 99) div 100")).groupBy(*by).agg(F.min(value).alias("p95"))


def throughput(rows: DataFrame, kind: str, size: str, bounds: tuple[int, ...] = (1_000, 10_000)) -> DataFrame:
    """Files and bytes by kind and size bucket."""
    at = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        at = F.when(F.col(size) < bounds[i], i).otherwise(at)
    return rows.groupBy(kind, at.alias("size_bucket")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("n_bytes"))


def rollup(samples: DataFrame, at: str, by: str, value: str, seconds: int = 60) -> DataFrame:
    """Samples, sum, mean and last value by key and window of event time (tumbling)."""
    w = F.window(at, f"{seconds} seconds")
    return samples.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max_by(value, at).alias("last")).select(F.col("w.start").alias("window_start"), by, "n", "total", "last")


def last_samples(samples: DataFrame, at: str, by: str, value: str, seconds: int) -> DataFrame:
    """For each sample, the number and sum of its key's samples of the last `seconds` seconds, itself included."""
    s = F.unix_seconds(at)
    w = Window.partitionBy(by).orderBy(s).rangeBetween(-(seconds - 1), 0)
    return samples.withColumn("recent_n", F.count(F.lit(1)).over(w)).withColumn("recent_sum", F.sum(value).over(w))


def gates(tasks: DataFrame, by: str, final: tuple[str, ...]) -> DataFrame:
    """Of each run, ready if all its tasks are final and synced up to their highest change; else waiting."""
    ready = F.bool_and(F.col("state").isin(list(final)) & (F.coalesce("synced", F.lit(-1)) >= F.col("highest")))
    return tasks.groupBy(by).agg(F.when(F.coalesce(ready, F.lit(False)), "ready").otherwise("waiting").alias("gate"))
