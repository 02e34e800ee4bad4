"""Schemas of the stored tables, and the checks that their rows must pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.functions.hashing import is_digest


@dataclass(frozen=True)
class Table:
    """A table's columns, its key and named checks; a check that is unknown (null) doesn't hold."""

    schema: T.StructType
    key: tuple[str, ...]
    checks: dict[str, Column] = field(default_factory=dict)


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # needs an active session


def tables() -> dict[str, Table]:
    """All tables by name."""
    live = F.col("status").isin("active", "pending", "done", "partial", "failed", "deleted")
    return {
        "files": Table(
            _struct("id long, machine_id string, disk_no int, path string, size long, mtime long, sha512 string, status string, missing_mask int"),
            ("machine_id", "path"),
            {"status": live, "size": F.col("size") >= 0, "sha512": F.col("sha512").isNull() | is_digest(F.col("sha512"))},
        ),
        "contents": Table(
            _struct("content_id long, md5 binary, file_size long, media_kind string, base_complete boolean"),
            ("md5", "file_size"),
            {"md5": F.length("md5") == 16, "file_size": F.col("file_size") >= 0, "media_kind": F.col("media_kind").isin("image", "video", "other")},
        ),
        "image_features": Table(
            _struct("sha512 string, width int, height int, pdq256 binary, pdq_quality int, phash_parts binary, sobel_hist binary"),
            ("sha512",),
            {"sha512": is_digest(F.col("sha512")), "pdq256": F.col("pdq256").isNull() | (F.length("pdq256") == 32), "phash_parts": F.col("phash_parts").isNull() | (F.length("phash_parts") == 76), "sobel_hist": F.col("sobel_hist").isNull() | (F.length("sobel_hist") == 516), "pdq_quality": F.col("pdq_quality").isNull() | F.col("pdq_quality").between(0, 100)},
        ),
        "video_frames": Table(_struct("sha512 string, frame_idx int, pdq256 binary, phash_parts binary, sobel_hist binary"), ("sha512", "frame_idx"), {"frame_idx": F.col("frame_idx").between(0, 5)}),
        "machines": Table(_struct("machine_id string, committed_seq long"), ("machine_id",), {"machine_id": is_digest(F.rtrim("machine_id"), 64), "committed_seq": F.col("committed_seq") >= 0}),
    }


def validated(df: DataFrame, table: Table) -> DataFrame:
    """df in the table's column order with `violations`, the names of the checks that a row fails, sorted."""
    failed = [F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in sorted(table.checks.items())]
    names = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array().cast("array<string>")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields], names.alias("violations"))


def split(df: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and rows to count and set aside."""
    rows = validated(df, table)
    return rows.where(F.size("violations") == 0).drop("violations"), rows.where(F.size("violations") > 0)
