"""Vectorised text helpers: whole Arrow string columns as flat byte arrays, words and hashes of words.

Every helper works on bounded pieces of a batch (`slices`), so the temporary arrays stay within a few MB whatever the
batch size; only a single text longer than the bound is taken alone.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

PIECE_BYTES = 1 << 19
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LONG = 256
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def release() -> None:
    """Give freed memory back to the system, as Python workers outlive their tasks and stand beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has nothing to trim
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; /tmp only where all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/checkpoints"
    return f"{where}/gemello-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str) -> DataFrame:
    """df written as Parquet in a shared folder and read again, which cuts its lineage."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def through(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(work, schema) with batches of about BATCH_BYTES, not Spark's 64 MB, unless the session has a value of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(work, schema)


def appended(df: DataFrame, columns: list[str], fields: list[StructField], work: Callable[[list[pa.Array]], list], keep: list[str] | None = None) -> DataFrame:
    """df[keep] (all columns by default) with new columns that `work` makes from pieces of the given columns.

    An input column with the name of a new one is replaced. `work` gets equally long Arrow arrays and returns one
    array, list or NumPy array for each field.
    """
    names = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    inner = df.select(*[df[c] for c in kept], *[df[c].alias(f"__in{i}") for i, c in enumerate(columns)])
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(f.name, f.dataType, True) for f in fields]])
    arrow = to_arrow_schema(schema)
    n = len(kept)

    def run(batches):
        for batch in batches:
            for at, size in slices(batch, n):
                part = batch.slice(at, size)
                made = work([part.column(n + i) for i in range(len(columns))])
                new = [x.cast(arrow.field(n + i).type) if isinstance(x, pa.Array) else pa.array(x, arrow.field(n + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(arrow.field(i).type) for i in range(n)], *new], schema=arrow)
                del part, made, new
        release()

    return through(inner, run, schema)


def slices(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive pieces of about `limit` bytes of a string column."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type)):
        yield 0, n
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to - at
        at = to


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of each."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross the texts' offsets."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    after = before[1:].copy()
    before = before[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first = inside & ~before
    first[cuts] = inside[cuts]
    last = np.zeros(len(inside), bool)
    last[:-1] = after[:-1] & ~inside[1:]
    if len(inside):
        last[-1] = inside[-1]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: blocks of eight bytes pass one after another through `mix`; longer ranges than LONG take BLAKE2b.

    Each step is a bijection of the block, so ranges of up to eight bytes and equal length never collide; others do by
    chance alone, as mixing isn't linear in the bytes (no pair of texts collides by its structure).
    """
    n = len(data)
    size = ends - starts
    room = np.zeros(n + 8, np.uint8)
    room[:n] = data
    eight = np.ndarray((n + 1,), "<u8", room, strides=(1,))  # the eight bytes that begin at each place
    h = mix(size.astype(np.uint64) * _FACTOR + (eight[starts] & _FIRST[np.minimum(size, 8)]))
    open_ = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(open_):
        block = eight[starts[open_] + done] & _FIRST[np.minimum(size[open_] - done, 8)]
        h[open_] = mix(h[open_] * _FACTOR + block)
        done += 8
        open_ = open_[size[open_] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(room[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    return h


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each text the range of its words."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)
