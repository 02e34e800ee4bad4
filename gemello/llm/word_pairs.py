"""Word pairs of a whole corpus as a partitioned table: how rare the pairs of a text are in all other texts.

The table has one entry for each different pair, so it grows with the corpus. It is never broadcast: pieces of texts send
their pairs to buckets of pair hashes as packed arrays, a bucket counts its pairs and answers each piece with sums by
text. Pairs are of neighbouring words without case, of all languages together, so that a passage of another language
meets its own pairs. A hash's rest names the bucket and 32 bits of its quotient the pair in it; as a bucket takes a
fixed amount of text, one in some thousand unseen pairs passes for a seen one at any size of corpus. A text's own
occurrences don't count for it; those of equal texts do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.llm.text import flat, hashes, lower, mix, release, slices, through, words

PIECE = 1 << 22  # bytes of texts with 64 for each row, so that a place in a piece fits 16 bits
BUCKET = 1 << 24  # bytes of texts for each bucket
UNIT = 1 / 256  # logarithms are summed as whole numbers of units, so that no order of sums changes a result


def _pairs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each pair of neighbouring words, and the place of its text."""
    data, offsets = flat(col)
    starts, ends, at = words(data, offsets)
    h = hashes(lower(data), starts, ends)
    doc = np.repeat(np.arange(len(col)), np.diff(at))
    inside = doc[:-1] == doc[1:]
    return mix(mix(h[:-1]) + h[1:])[inside], doc[:-1][inside]


def _short(values: np.ndarray, kind: type) -> bytes:
    """Whole numbers as bytes of a short kind, or of 64 bits where one of them doesn't fit."""
    limits = np.iinfo(kind)
    fits = len(values) == 0 or (values.min() >= limits.min and values.max() <= limits.max)
    return values.astype(kind if fits else np.int64).tobytes()


def _long(raw: bytes, n: int, kind: type) -> np.ndarray:
    """The n numbers that _short packed."""
    return np.frombuffer(raw, kind if len(raw) == n * np.dtype(kind).itemsize else np.int64).astype(np.int64)


def known(documents: DataFrame) -> DataFrame:
    """key (xxhash64 of the text) and total: the sum in UNITs, over the text's pairs, of log(0.5 + how often the pair stands in other texts)."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BUCKET))

    def ask(batches):
        made = 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, length in slices(batch, 1, PIECE):
                part = batch.slice(at, length)
                gram, doc = _pairs(part.column(1))
                if not len(gram):
                    continue
                bucket = (gram % np.uint64(n)).astype(np.int64)
                gram = (gram // np.uint64(n)).astype(np.uint32)
                order = np.lexsort((gram, doc, bucket))
                gram, doc, bucket = gram[order], doc[order], bucket[order]
                new = np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1]))
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(gram)))
                gram, doc, bucket = gram[first], doc[first].astype(np.uint16), bucket[first]
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                pieces = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                columns = [
                    pa.array([int(bucket[a]) for a, _ in pieces], pa.int64()),
                    pa.array([task | made] * len(pieces), pa.int64()),
                    pa.array([keys, *[None] * (len(pieces) - 1)], pa.binary()),
                    *[pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary()) for x in (gram, doc)],
                    pa.array([_short(times[a:b], np.uint8) for a, b in pieces], pa.binary()),
                ]
                made += 1
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "piece", "keys", "gram", "doc", "times"])
        release()

    def answer(table: pa.Table) -> pa.Table:
        gram, doc = (np.frombuffer(b"".join(table.column(x).to_pylist()), kind) for x, kind in (("gram", np.uint32), ("doc", np.uint16)))
        sizes = [len(x) // 2 for x in table.column("doc").to_pylist()]
        ends = np.cumsum(sizes)
        times = np.concatenate([_long(x, n, np.uint8) for x, n in zip(table.column("times").to_pylist(), sizes)])
        order = np.argsort(gram)
        own = gram[order]
        group = np.cumsum(np.append(False, own[1:] != own[:-1]))
        total = np.bincount(group, times[order])
        others = np.empty(len(gram))
        others[order] = total[group]
        value = np.rint(np.log(others - times + 0.5) / UNIT).astype(np.int64) * times
        docs, sums = [], []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            first = np.flatnonzero(np.append(True, doc[a + 1 : b] != doc[a : b - 1]))
            docs.append(doc[a:b][first].tobytes())
            sums.append(_short(np.add.reduceat(value[a:b], first), np.int16))
        release()
        return pa.table({"piece": table.column("piece"), "keys": table.column("keys"), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary())})

    def gathered(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(next(k for k in table.column("keys").to_pylist() if k is not None), np.int64)
        total, seen = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for docs, sums in zip(table.column("docs").to_pylist(), table.column("sums").to_pylist()):
            place = np.frombuffer(docs, np.uint16)
            total[place] += _long(sums, len(place), np.int16)
            seen[place] = True
        return pa.table({"key": keys[seen], "total": total[seen]})

    asked = documents.where("text is not null").select(F.xxhash64("text").alias("key"), "text")
    asked = through(asked, ask, "bucket long, piece long, keys binary, gram binary, doc binary, times binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "piece long, keys binary, docs binary, sums binary")
    sums = answers.groupBy("piece").applyInArrow(gathered, "key long, total long")
    return sums.groupBy("key").agg(F.max("total").alias("total"))
