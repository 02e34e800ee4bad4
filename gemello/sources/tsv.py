"""Result files: tab-separated text with a header line H, member lines M and a footer F of count and SHA-256.

The member lines are written by Spark in order (range-partitioned), so only lines pass the driver, one at a time, when
one checksummed file is made of them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.functions.paths import tsv


def lines(members: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """`value`: the member lines in order."""
    fields = [tsv(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return members.orderBy(*order).select(F.concat_ws("\t", F.lit("M"), *fields).alias("value"))


def publish(members: DataFrame, columns: list[str], order: list[str], path: str) -> str:
    """Write, check and then rename a result file on the driver's file system; its SHA-256 of H and M lines comes back."""
    digest, n, part = hashlib.sha256(), 0, f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        head = "\t".join(["H", *columns]) + "\n"
        digest.update(head.encode())
        f.write(head)
        for row in lines(members, columns, order).toLocalIterator():
            line = row["value"] + "\n"
            digest.update(line.encode())
            f.write(line)
            n += 1
        f.write(f"F\t{n}\t{digest.hexdigest()}\n")
        f.flush()
        os.fsync(f.fileno())
    verify(part)
    os.replace(part, path)
    return digest.hexdigest()


def verify(path: str) -> int:
    """The number of members of a result file; an error if its footer doesn't hold."""
    digest, n, footer = hashlib.sha256(), 0, None
    with open(path, "rb") as f:
        for line in f:
            if line.startswith(b"F\t"):
                footer = line.decode().rstrip("\n").split("\t")
                continue
            if footer is not None or not line.startswith((b"H\t", b"M\t")):
                raise ValueError("a line is out of place")
            digest.update(line)
            n += line.startswith(b"M\t")
    if footer != ["F", str(n), digest.hexdigest()]:
        raise ValueError("the footer doesn't match the lines")
    return n


def read_members(path: str) -> Iterator[list[str]]:
    verify(path)
    with open(path, encoding="utf-8", newline="") as f:
        for line in f:
            if line.startswith("M\t"):
                yield line.rstrip("\n").split("\t")[1:]
