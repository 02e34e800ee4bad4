"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order (by a hash of their ids) and their words form one stream, which is cut
into blocks of equally many words. The points of a golden-ratio sequence, mapped through the cumulative targets, give
each slot of the mix a source; the slot's rank among its source's slots names the block it takes, and ranks beyond the
last block begin the stream again. Ranks stop where the source's target is met, in the middle of its last block. Where
the sequence leaves a source a few slots short (its discrepancy grows as the logarithm of the number of slots), they
follow at the end. Blocks and slots meet in a join on source and block.

Texts are read once for their sizes, which are written to the shared folder with a number for each row; all planning
goes over that small table. Running sums go over buckets and then within each (`bucketed_sum`), so that no task holds a
source. The driver holds one row for each source: the list of sources is the mix's configuration.

Defined results: a null source is a source of its own, last in order; null or empty texts have size 0 and are never
taken; rows that repeat a doc_id, equal ones too, are documents of their own (equal rows may change places between
reruns, which changes no result); rows without a doc_id are spread by their place in the table; an empty table gives an
empty mix; extra columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm.text import appended, flat, shared_dir, through, words, written

BLOCK_WORDS = 512
SLOTS_A_CHUNK = 1 << 16
#: Golden-ratio steps on a lattice of 2**31 points: exact in 64 bits, and balanced again after each period.
PERIOD = 1 << 31
STEP = int(PERIOD * (math.sqrt(5) - 1) / 2) | 1


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float

    def plan(self, block: int) -> tuple[int, int, int]:
        """Blocks of the stream, slots that meet the target, and words that the last of them gives."""
        blocks = -(-self.size // block)
        goal = min(round(self.target), 2 * self.size)
        if not goal:
            return blocks, 0, 0
        rounds, rest = divmod(goal, self.size)
        if rest:
            return blocks, rounds * blocks + -(-rest // block), (rest - 1) % block + 1
        return blocks, rounds * blocks, self.size - (blocks - 1) * block


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[Source]:
    """Targets by repeating weights over the sources in order of code points, null last; none exceeds `most` times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    left = share * sum(n for _, n in order)
    target = [0.0] * len(order)
    free = list(range(len(order)))
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > most * order[i][1]]
        if not over:
            for i in free:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = most * order[i][1]
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return [Source(name, n, t) for (name, n), t in zip(order, target, strict=True)]


def sized(documents: DataFrame, keep: list[str]) -> DataFrame:
    """documents[keep] with `size`, the number of words, and `mark`, a hash of the text (null without one)."""

    def work(cols: list[pa.Array]) -> list:
        return [np.diff(words(*flat(cols[0]))[2])]

    marked = documents.select(*keep, "text", F.xxhash64("text").alias("mark"))
    return appended(marked, ["text"], [T.StructField("size", T.LongType())], work, [*keep, "mark"])


def bucketed_sum(rows: DataFrame, group: str, order: list[str], value: str, key: str, bits: int) -> DataFrame:
    """rows with `upto`, the sum of a value over all rows of the group up to this one, by an evenly spread 64-bit key.

    The first `bits` bits of the key name a bucket: sums run within each bucket and over the buckets' totals.
    """
    rows = rows.withColumn("__bucket", F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long"))
    totals = rows.groupBy(group, "__bucket").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__within", F.sum(value).over(inside))
    joined = rows.join(totals, (rows[group] == totals["__g"]) & (rows["__bucket"] == totals["__b"]))
    return joined.withColumn("upto", F.col("__before") + F.col("__within")).drop("__bucket", "__within", "__g", "__b", "__before")


@dataclass
class Mix:
    """A planned mix: its sources, the documents with their places in the streams, and the schedule of slots."""

    sources: list[Source]
    documents: DataFrame
    slots: DataFrame
    block: int

    def taken(self) -> DataFrame:
        """The documents' columns with source_size, target, taken: what the join of slots and blocks takes of each document."""
        b = self.block
        d = self.documents
        own = [c for c in d.columns if c != "start"]
        pieces = d.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
        s = self.slots.select(F.col("sid").alias("s_sid"), F.col("block").alias("s_block"), "words").hint("merge")
        got = pieces.join(s, (pieces["sid"] == s["s_sid"]) & (pieces["block"] == s["s_block"]))
        lo = F.greatest(F.col("start"), F.col("block") * b)
        hi = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
        got = got.select(*own, F.greatest(hi - lo, F.lit(0).cast("long")).alias("taken"))
        # a document of which no block is taken still counts, with nothing taken
        all_rows = got.unionByName(d.select(*own, F.lit(0).cast("long").alias("taken"))).groupBy(*own).agg(F.sum("taken").alias("taken"))
        about = all_rows.sparkSession.createDataFrame([(i, x.size, float(x.target)) for i, x in enumerate(self.sources)], "sid2 int, source_size long, target double")
        return all_rows.join(F.broadcast(about), F.col("sid") == F.col("sid2")).select(*[c for c in own if c not in ("sid", "key")], "source_size", "target", "taken")


def schedule(spark, sources: list[Source], block: int = BLOCK_WORDS) -> DataFrame:
    """slot, sid (index of the source), epoch, block and words of each slot of the mix."""
    plans = [s.plan(block) for s in sources]
    need = np.array([p[1] for p in plans], np.int64)
    blocks = np.array([max(p[0], 1) for p in plans], np.int64)
    ends = np.array([p[2] for p in plans], np.int64)
    last = np.array([s.size - (p[0] - 1) * block for s, p in zip(sources, plans, strict=True)], np.int64)
    n = int(need.sum())
    upto = np.cumsum(need) / max(n, 1)
    chunks = spark.range(0, -(-n // SLOTS_A_CHUNK), 1, max(1, min(4096, n // SLOTS_A_CHUNK + 1)))

    def hits(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                slot = np.arange(c * SLOTS_A_CHUNK, min(n, (c + 1) * SLOTS_A_CHUNK), dtype=np.int64)
                u = (((slot % PERIOD) * STEP + STEP // 2) % PERIOD) / PERIOD
                sid = np.searchsorted(upto, u, "right").astype(np.int32)
                order = np.argsort(sid, kind="stable")
                found, first = np.unique(sid[order], return_index=True)
                cuts = np.append(first, len(order)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(slot[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c)), pa.array(found), pa.array(np.diff(cuts).astype(np.int64)), lists], names=["chunk", "sid", "n", "slots"])

    found = written(through(chunks, hits, "chunk long, sid int, n long, slots array<long>"), f"{shared_dir(spark)}/slots")
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.select(F.col("chunk").alias("c"), F.col("sid").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    got = {r["sid"]: r["n"] for r in found.groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    about = F.broadcast(spark.createDataFrame([(i, int(need[i]), int(blocks[i]), int(ends[i]), int(last[i])) for i in range(len(sources))], "s2 int, need long, blocks long, tail long, last_words long"))
    placed = found.hint("merge").join(offsets.hint("merge"), (F.col("chunk") == F.col("c")) & (F.col("sid") == F.col("s")))
    slots = placed.select("sid", "before", F.posexplode("slots").alias("pos", "slot")).select("slot", "sid", (F.col("pos") + F.col("before")).alias("rank"))
    short = [(i, got.get(i, 0), int(need[i])) for i in range(len(sources)) if got.get(i, 0) < need[i]]
    if short:
        more = spark.createDataFrame(short, "sid int, lo long, hi long").select((F.lit(n) + F.col("sid")).cast("long").alias("slot"), "sid", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("rank"))
        slots = slots.unionByName(more)
    s = slots.join(about, F.col("sid") == F.col("s2")).where("rank < need")
    at = F.expr("rank % blocks")
    size = F.when(F.col("rank") == F.col("need") - 1, F.col("tail")).when(at == F.col("blocks") - 1, F.col("last_words")).otherwise(F.lit(block))
    return s.select("slot", "sid", F.expr("rank div blocks").alias("epoch"), at.alias("block"), size.cast("long").alias("words"))


def mix(documents: DataFrame, block: int = BLOCK_WORDS, seed: int = 7, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> Mix:
    """Plan the mix of documents with columns doc_id, source, size and mark (see `sized`); others pass through to the mix's documents."""
    spark = documents.sparkSession
    d = written(documents.withColumn("row", F.monotonically_increasing_id()), f"{shared_dir(spark)}/sizes")
    totals = d.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    sources = targets([(r["source"], r["n"]) for r in totals], weights, share, most)
    bits = max(0, round(math.log2(max(1, sum(r["docs"] for r in totals))) / 2))
    names = F.broadcast(spark.createDataFrame([(i, s.name) for i, s in enumerate(sources)], "sid int, name string"))
    d = d.join(names, d["source"].eqNullSafe(names["name"])).drop("name")
    # equal documents of an equal id differ in their row alone, and whichever comes first has the same words;
    # there may be very many without an id, so these are spread by their rows
    d = d.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size", "mark", F.when(F.col("doc_id").isNull(), F.col("row") % 4096)))
    d = bucketed_sum(d, "sid", ["key", "doc_id", "size", "mark", "row"], "size", "key", bits)
    d = d.withColumn("start", F.col("upto") - F.col("size")).drop("upto", "key", "mark")
    return Mix(sources, d, schedule(spark, sources, block), block)


def named_rows(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """documents with columns that name each row, the same in every scan; and these columns.

    Rows of Parquet files have a file and a place in it; other documents are written to the shared folder first.
    """

    def named(d: DataFrame) -> DataFrame:
        return d.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))

    by = ["__file", "__place"]
    if "_metadata" not in documents.columns:
        try:
            return named(documents), by
        except AnalysisException:  # not rows of files
            pass
    kept = documents.withColumnRenamed("_metadata", "__metadata") if "_metadata" in documents.columns else documents
    out = named(written(kept, f"{shared_dir(documents.sparkSession)}/documents"))
    return out.withColumnRenamed("__metadata", "_metadata") if kept is not documents else out, by


def mixed_rows(documents: DataFrame, taken: DataFrame, by: list[str]) -> DataFrame:
    """Rows of documents as the mix takes them: whole copies, and the first words where only a part is taken.

    documents has text, and in the columns `by` what names a row; `taken` has these, size and taken. All columns but `by` come back.
    """
    columns = [c for c in documents.columns if c not in by]
    t = taken.where("taken > 0").select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    same = [documents[c] == t[f"__by{i}"] for i, c in enumerate(by)]
    # how often the text comes whole, and how many of its words once more
    whole = F.array_repeat(F.col("__size"), F.expr("cast(__taken div __size as int)"))
    part = F.expr("__taken % __size")
    d = documents.join(t, same)
    d = d.withColumn("__words", F.explode(F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.expr("array()").cast("array<bigint>")))))

    def work(cols: list[pa.Array]) -> list:
        data, offsets = flat(cols[0])
        _, ends, at = words(data, offsets)
        raw = data.tobytes()
        out = []
        for i, (n, size) in enumerate(zip(cols[1].to_pylist(), cols[2].to_pylist(), strict=True)):
            out.append(raw[offsets[i] : offsets[i + 1] if n == size else ends[at[i] + n - 1]].decode())
        return [out]

    cut = appended(d, ["text", "__words", "__size"], [T.StructField("text", T.StringType())], work, keep=[c for c in columns if c != "text"])
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return cut.select(*columns)
