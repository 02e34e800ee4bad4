"""Functions over Windows paths and file names, as columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of images and videos.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff")
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".ts", ".m2ts", ".mpg", ".mpeg", ".webm", ".3gp")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    """From the last full stop of the file name, as it is written; empty without one."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def media_kind(path: Column, images: tuple[str, ...] = IMAGE_EXTENSIONS, videos: tuple[str, ...] = VIDEO_EXTENSIONS) -> Column:
    e = F.lower(extension(path))
    return F.when(e.isin([x.lower() for x in images]), "image").when(e.isin([x.lower() for x in videos]), "video").otherwise("other")


def _collapsed(parts: Column) -> Column:
    """Components without empty ones and ".", each ".." taking the one before it; null where there is none to take."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(state, part):
        up = part == ".."
        shorter = F.when(F.size(state["kept"]) > 0, F.slice(state["kept"], 1, F.greatest(F.size(state["kept"]) - 1, F.lit(0)))).otherwise(state["kept"])
        kept = F.when(part.isin("", "."), state["kept"]).when(up, shorter).otherwise(F.concat(state["kept"], F.array(F.upper(part))))
        return F.struct(kept.alias("kept"), (state["ok"] & ~(up & (F.size(state["kept"]) == 0))).alias("ok"))

    end = F.aggregate(parts, start, step)
    return F.when(end["ok"], end["kept"])


def normalized(path: Column) -> Column:
    r"""An absolute path with "\", without verbatim prefixes, upper-cased and collapsed; null where it isn't absolute."""
    p = F.replace(path, F.lit("/"), F.lit("\\"))
    p = F.when(F.upper(F.substring(p, 1, 8)) == "\\\\?\\UNC\\", F.concat(F.lit("\\\\"), F.substring(p, 9, 1 << 30))).when(F.startswith(p, F.lit("\\\\?\\")), F.substring(p, 5, 1 << 30)).otherwise(p)
    drive = _collapsed(F.split(F.substring(p, 4, 1 << 30), r"\\"))
    on_drive = F.concat(F.upper(F.substring(p, 1, 2)), F.lit("\\"), F.array_join(drive, "\\"))
    shared = F.filter(F.split(F.substring(p, 3, 1 << 30), r"\\"), lambda x: x != "")
    rest = _collapsed(F.slice(shared, 3, 1 << 20))
    on_share = F.concat(F.lit("\\\\"), F.upper(F.get(shared, F.lit(0))), F.lit("\\"), F.upper(F.get(shared, F.lit(1))), F.lit("\\"), F.array_join(rest, "\\"))
    return F.when(p.rlike(r"^[A-Za-z]:\\"), on_drive).when(F.startswith(p, F.lit("\\\\")), on_share)


def is_within(path: Column, directory: Column) -> Column:
    """Whether a normalized path is a directory or lies in it, component by component."""
    stem = F.regexp_replace(directory, r"\\+$", "")
    return (path == directory) | (path == stem) | F.startswith(path, F.concat(stem, F.lit("\\")))


def contains_text(path: Column, text: str) -> Column:
    """Case-insensitive substring without wildcards."""
    return F.instr(F.lower(path), text.lower()) > 0


def tsv(value: Column) -> Column:
    r"""A TSV field: tab, line ends and NUL are written as \x09, \x0d, \x0a and \x00."""
    for raw, shown in (("\t", "\\x09"), ("\r", "\\x0d"), ("\n", "\\x0a"), ("\0", "\\x00")):
        value = F.replace(value, F.lit(raw), F.lit(shown))
    return value


def task_root(path: Column) -> Column:
    """A task's root, cleaned and in lower case; null where it has a parent component, isn't absolute or is a whole drive or share."""
    clean = F.rtrim(normalized(path), F.lit("\\"))
    parents = F.array_contains(F.split(F.replace(path, F.lit("/"), F.lit("\\")), r"\\"), "..")
    whole = clean.rlike(r"^[A-Z]:$") | clean.rlike(r"^\\\\[^\\]+\\[^\\]+$")
    return F.when(~parents & ~whole, F.lower(clean))
