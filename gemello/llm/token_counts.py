"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

The histogram has one row for each length that occurs, so it is small beside the corpus. Prefix and suffix sums go over
blocks of lengths and then over the blocks' totals, so that no task holds all lengths.

Defined results: null and empty texts have length 0; an empty table gives an empty histogram; repeated rows count each
time; columns of the input other than the text don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm.bpe import loaded
from gemello.llm.text import appended, shared_dir, written

BLOCK = 1024


def lengths(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df[keep] with n_tokens, the length of each whole text under a vocabulary file."""
    return appended(df, [text], [T.StructField("n_tokens", T.LongType())], lambda cols: [np.diff(loaded(path).encode(cols[0])[1])], keep)


def histogram(counted: DataFrame, length: str = "n_tokens") -> DataFrame:
    """length and n_docs, written to the shared folder: it is small, and the texts behind it are encoded once."""
    made = counted.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    return written(made, shared_dir(counted.sparkSession))


def limits(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents and tokens up to it, beyond it and cut to it.

    Columns: length, n_docs; docs_up_to, tokens_up_to (of documents no longer than the limit); docs_longer, tokens_longer;
    total_tokens; truncated_tokens (all documents cut to the limit); share_up_to (docs_up_to over all documents).
    """
    h = hist.select(F.col("length").cast("long").alias("length"), F.col("n_docs").cast("long").alias("n_docs"), F.floor(F.col("length") / BLOCK).alias("block"))
    tokens = F.col("length") * F.col("n_docs")
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    over = Window.orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    sums = sums.select(
        "block",
        F.coalesce(F.sum("block_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length")
    h = h.join(sums, "block").select(
        "length",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_up_to"),
        (F.col("tokens_before") + F.sum(tokens).over(inside)).alias("tokens_up_to"),
        "all_docs",
        "total_tokens",
    )
    longer = F.col("all_docs") - F.col("docs_up_to")
    return h.select(
        "length",
        "n_docs",
        "docs_up_to",
        "tokens_up_to",
        longer.alias("docs_longer"),
        (F.col("total_tokens") - F.col("tokens_up_to")).alias("tokens_longer"),
        "total_tokens",
        (F.col("tokens_up_to") + F.col("length") * longer).alias("truncated_tokens"),
        (F.col("docs_up_to") / F.col("all_docs")).alias("share_up_to"),
    )


def at_limits(hist: DataFrame, asked: list[int]) -> DataFrame:
    """The same answers for any limits asked for: context_limit, docs_longer, total_tokens, truncated_tokens."""
    spark = hist.sparkSession
    want = F.broadcast(spark.createDataFrame([(x,) for x in asked], "context_limit long"))
    cut = F.least("length", "context_limit")
    own = hist.crossJoin(want).groupBy("context_limit")
    return own.agg(
        F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.col("length") * F.col("n_docs")).alias("total_tokens"),
        F.sum(cut * F.col("n_docs")).alias("truncated_tokens"),
    )


def quantiles(answers: DataFrame, shares: list[float]) -> DataFrame:
    """share and length: the smallest length that at least this share of the documents doesn't exceed (nearest rank)."""
    total = [F.min(F.when(F.col("share_up_to") >= s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])
    return answers.agg(*total).select(F.explode(pairs).alias("q")).select("q.*")
