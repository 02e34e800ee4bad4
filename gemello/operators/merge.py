"""Keyed merges, reconciliation and change folds: upserts as joins and column-wise folds, written to a new version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer merge by keys with a rule for each column.

    new: new or else old; positive: new if > 0, else old; sticky: true once it was; quality: new if within 0..100; last:
    the new row's value, even null; greatest: the larger.
    """
    o = old.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"o_{c}") for c in rules], F.lit(True).alias("o_is"))
    n = new.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"n_{c}") for c in rules], F.lit(True).alias("n_is"))
    both = o.join(n, keys, "full")

    def fold(c: str, rule: str) -> Column:
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        return {
            "new": lambda: F.coalesce(b, a),
            "positive": lambda: F.when(b > 0, b).otherwise(a),
            "sticky": lambda: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
            "quality": lambda: F.when(b.between(0, 100), b).otherwise(a),
            "last": lambda: F.when(F.col("n_is"), b).otherwise(a),
            "greatest": lambda: F.greatest(a, b),
        }[rule]()

    return both.select(*keys, *[fold(c, r).alias(c) for c, r in rules.items()])


def folded(changes: DataFrame, key: str, seq: str, rules: dict[str, Callable[[], Column] | str]) -> DataFrame:
    """The last state of each key of a change log: last values that are known or positive, sticky flags, and the last seq."""

    def fold(c: str, rule) -> Column:
        valid = {"new": F.col(c).isNotNull(), "positive": F.col(c) > 0, "quality": F.col(c).between(0, 100)}
        if rule == "sticky":
            return F.bool_or(F.coalesce(F.col(c), F.lit(False)))
        if rule == "last":
            return F.max_by(c, seq)
        return F.max_by(c, F.when(valid[rule], F.col(seq)))

    return changes.groupBy(key).agg(F.max(seq).alias("last_seq"), *[fold(c, r).alias(c) for c, r in rules.items()])


def enumerated(old: DataFrame, seen: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Seen files with the state they keep or start with: unchanged size, time and digest of a file that isn't deleted keep it."""
    o = old.select(*keys, F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.col("content").alias("o_content"), F.col("status").alias("o_status"))
    same = (F.col("size") == F.col("o_size")) & (F.col("mtime") == F.col("o_mtime")) & F.col("o_content").isNotNull() & (F.col("o_status") != "deleted") & F.lit(not force)
    rows = seen.join(o, keys, "left")
    kept = F.coalesce(same, F.lit(False))
    return rows.select(*keys, "size", "mtime", F.when(kept, F.col("o_content")).alias("content"), F.when(kept, F.col("o_status")).otherwise("pending").alias("status"))


def hashed(files: DataFrame, results: DataFrame, key: str, bit: int = 1) -> DataFrame:
    """files with new digests: the bit goes from the missing mask where a result came."""
    r = results.select(key, F.col("content").alias("new_content"))
    rows = files.join(r, key, "left")
    came = F.col("new_content").isNotNull()
    mask = F.when(came, F.col("missing").bitwiseAND(~bit)).otherwise(F.col("missing"))
    return rows.select(*[c for c in files.columns if c not in ("content", "missing")], F.coalesce("new_content", "content").alias("content"), mask.alias("missing"))


def snapshot(old: DataFrame, new: DataFrame, keys: list[str], machine: str) -> DataFrame:
    """A machine's full snapshot replaces its rows: those that are missing become inactive, other machines stay."""
    own = old.where(F.col("machine_id") == machine)
    missing = own.join(new.select(*keys), keys, "left_anti").withColumn("active", F.lit(False))
    return old.where(F.col("machine_id") != machine).unionByName(missing).unionByName(new.withColumn("active", F.lit(True)).select(*old.columns))


def reconciled(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key and action of a scan: insert, update, skip or deactivate."""
    k = known.select(F.col(key), F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), F.lit(True).alias("k_is"))
    s = seen.select(F.col(key), F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"), F.lit(True).alias("s_is"))
    both = k.join(s, key, "full")
    same = F.col("k_size").eqNullSafe(F.col("s_size")) & F.col("k_mtime").eqNullSafe(F.col("s_mtime"))
    action = F.when(F.col("k_is").isNull(), "insert").when(F.col("s_is").isNull(), "deactivate").when(same, "skip").otherwise("update")
    return both.select(key, action.alias("action"))


def scores_kept(old: DataFrame, new: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Scores by pair; a new document that differs from the stored one is an error, an equal one changes nothing."""
    both = old.select(*keys, F.col(document).alias("o")).join(new.select(*keys, F.col(document).alias("n")), keys, "full")
    clash = F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("o") != F.col("n"))
    checked = F.when(clash, F.raise_error(F.lit("a stored score differs"))).otherwise(F.coalesce("o", "n"))
    return both.select(*keys, checked.alias(document))


def without_stale(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scores that still have a candidate pair, in either direction."""
    c = candidates.select(F.least("left", "right").alias("lo"), F.greatest("left", "right").alias("hi")).distinct()
    on = (F.least(scores["left"], scores["right"]) == c["lo"]) & (F.greatest(scores["left"], scores["right"]) == c["hi"])
    return scores.join(c, on, "left_semi")


def children_replaced(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that come anew are replaced whole; others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def faults(log: DataFrame, keys: list[str], at: str, text: str) -> DataFrame:
    """Occurrences, first and last time and last message of each fault."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max_by(text, F.struct(at, text)).alias("message"))


def recovered(tasks: DataFrame) -> DataFrame:
    """States after a crash."""
    s = F.col("state")
    return tasks.withColumn("state", F.when(s.isin("pending", "running"), "waiting_recovery").when(s == "pausing", "paused").when(s == "stopping", "cancelled").otherwise(s))


#: The states that a task may go to from each state.
TRANSITIONS = {
    "pending": ("running", "pausing", "stopping", "deleting", "waiting_recovery"),
    "running": ("pausing", "stopping", "deleting", "succeeded", "failed", "waiting_recovery"),
    "waiting_recovery": ("running", "pausing", "stopping", "deleting", "failed"),
    "pausing": ("paused", "stopping", "deleting", "failed", "waiting_recovery"),
    "paused": ("pending", "cancelled", "deleting"),
    "stopping": ("cancelled", "deleting", "failed", "waiting_recovery"),
    "failed": ("pending", "deleting"),
    "cancelled": ("pending", "deleting"),
    "deleting": ("delete_failed",),
    "succeeded": ("deleting",),
    "delete_failed": ("deleting",),
}


def allowed(moves: DataFrame, origin: str, to: str) -> DataFrame:
    """Moves that the table of transitions allows."""
    table = moves.sparkSession.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], f"{origin} string, {to} string")
    return moves.join(F.broadcast(table), [origin, to], "left_semi")
