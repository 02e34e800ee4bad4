"""Bounded samples of labelled documents for classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.llm.text import delete, shared_dir, written

#: Characters of all sampled texts together, which bounds the driver's memory; texts of any length take part, whole.
MOST_CHARS = 10_000_000


def held_out(modulus: int, remainder: int):
    """Whether a row's label is kept from learning: crc32(doc_id as text) mod modulus = remainder (false without a doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: dict[int, int], most_chars: int = MOST_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most most[value] documents of each value, the first by a hash of doc_id, none held out.

    The ids are chosen from the labels alone, so only a bounded list of ids meets the texts, in a broadcast join. The rows
    found are written to the shared folder; of these the first by the same hash are read, `most_chars` together at most.
    """
    spark = documents.sparkSession
    free = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("value"))
    free = free.where(~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max("value").alias("value"))
    chosen = None
    for value, n in most.items():
        own = free.where(F.col("value") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = own if chosen is None else chosen.unionByName(own)
    ids = spark.createDataFrame([(r["doc_id"], r["value"]) for r in chosen.collect()], "id long, value int")
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    where = shared_dir(spark)
    found = written(rows.select("doc_id", "value", "text", F.xxhash64("doc_id").alias("place"), F.length("text").cast("long").alias("n")), where)
    sizes = found.select("place", "doc_id", "n").toPandas().sort_values(["place", "doc_id", "n"])
    within = sizes[sizes["n"].cumsum() <= most_chars]
    if len(within) < len(sizes):
        place, doc_id, n = (int(x) for x in within.iloc[-1]) if len(within) else (0, 0, 0)
        found = found.where(f"place < {place}L or place = {place}L and (doc_id < {doc_id} or doc_id = {doc_id} and n <= {n})" if len(within) else "false")
    out = sorted({(r["doc_id"], r["text"]): r["value"] for r in found.select("doc_id", "text", "value").toLocalIterator()}.items())
    delete(spark, where)
    return [text for (_, text), _ in out], [value for _, value in out]
