"""Corpus pipeline: documents lose the toxic, the poor and the near-duplicate ones, are mixed to target weights and encoded.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame, which `run`
writes as Parquet under the shared folder and reads again as the next one's docs. All but the last return the columns
of documents; other columns that docs may have pass through them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemello.llm import bpe, minhash_dedup, quality_mil, source_mix, toxicity_crf
from gemello.llm.text import delete, read, shared_dir, written

TOXIC_FROM = 0.7
GOOD_FROM = 0.3
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _beside(docs: DataFrame, needed: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `work` returns, with docs' columns: those that it doesn't need go by other names meanwhile."""
    names = {c: c if c in needed else f"__column{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC_FROM or more go; texts without words stay."""
    model = toxicity_crf.learned(docs, read(spark, sf_dir, "labels"))
    return _beside(docs, ("doc_id", "text"), lambda d: toxicity_crf.scored(d, model).where(F.col("score") < TOXIC_FROM))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than GOOD_FROM go."""
    model = quality_mil.learned(docs, read(spark, sf_dir, "labels"))
    return _beside(docs, ("doc_id", "text"), lambda d: quality_mil.scored(d, model).where(F.col("score") >= GOOD_FROM))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates stays, once if its row repeats; rows without a doc_id stay."""
    kept = minhash_dedup.deduplicated(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()

    def work(d: DataFrame) -> DataFrame:
        same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
        own = d.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
        return own.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n").unionByName(d.where("doc_id is null"))

    return _beside(docs, ("doc_id", "text"), work)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes the document, the last with only the words that it takes; documents of which it takes none go."""

    def work(d: DataFrame) -> DataFrame:
        named, by = source_mix.named_rows(d)
        taken = source_mix.mix(source_mix.sized(named, ["doc_id", "source", *by])).taken()
        return source_mix.mixed_rows(named, taken, by)

    return _beside(docs, ("doc_id", "text", "source", "n_chars"), work)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded text of each row."""
    return bpe.digests(docs, VOCABULARY, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_weights),
    ("BPE encoding and decoding", tokens),
]
#: SQL can't express stages that learn from labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{where}/{i}")
            if i:
                delete(spark, f"{where}/{i - 1}")
    return docs
