"""Written tables of runs: inputs frozen once, classes of rows replaced whole, generations published by a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemello.streaming.sync import VersionedTable


def frozen(df: DataFrame, path: str) -> DataFrame:
    """What is frozen at a path: df, if nothing was before (K14). An earlier attempt that didn't finish counts as nothing."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class ClassTable:
    """Rows by class (a kind, a run), each replaced as a whole: readers see the old rows of a class or the new ones."""

    def __init__(self, spark: SparkSession, path: str, column: str, schema):
        self.spark, self.path, self.column, self.schema = spark, path, column, schema

    def _of(self, value: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{self.column}-{value.encode().hex()}", self.schema)

    def replace(self, value: str, df: DataFrame) -> None:
        """The class's rows become df's; an empty df leaves none."""
        self._of(value).replace(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]))

    def read(self, value: str) -> DataFrame:
        return self._of(value).read().withColumn(self.column, F.lit(value))


class Generations:
    """A table published by generations: rows are written aside, then the pointer moves to them."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.table = VersionedTable(spark, path, schema)

    def publish(self, df: DataFrame) -> int:
        """The number of the generation, from 1, that is current once this returns."""
        self.table.replace(df)
        return self.table.version() + 1

    def current(self) -> DataFrame:
        """The rows of the current generation with its number (0 and no rows before the first one)."""
        return self.table.read().withColumn("generation", F.lit(self.table.version() + 1))
