"""Runs of the second stage and their records: recovered pairs, rescoring, planning, single flights, gates, deadlines, commits.

All are joins and partial aggregations by the operator's own key; nothing gathers a group in one row. Rows that break a
rule are returned with the reason instead of stopping a whole run.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemello.operators.cluster import shared_dir, written
from gemello.operators.config import G, Thresholds
from gemello.operators.scoring import image_stage2


def recovered_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs of groups that have exactly two different live contents.

    members: group_id, content, status and the trace peer, hamming, quality_self, quality_peer (all null: no trace).
    Returns group_id, left, right, hamming, l_quality, r_quality (null without a trace) and problem: null, "range",
    "outside" (a trace names another pair) or "conflict" (traces differ).
    """
    live = members.where(F.col("status") != "deleted")
    turn = F.col("content") > F.col("peer")
    trace = F.struct(
        F.least("content", "peer").alias("left"),
        F.greatest("content", "peer").alias("right"),
        "hamming",
        F.when(turn, F.col("quality_peer")).otherwise(F.col("quality_self")).alias("l_quality"),
        F.when(turn, F.col("quality_self")).otherwise(F.col("quality_peer")).alias("r_quality"),
    )
    given = F.col("hamming").isNotNull()
    fit = F.col("hamming").between(0, 256) & F.col("quality_self").between(0, 100) & F.col("quality_peer").between(0, 100) & F.col("peer").isNotNull()
    own = live.groupBy("group_id").agg(
        F.min("content").alias("left"),
        F.max("content").alias("right"),
        F.count_distinct("content").alias("n"),
        F.min(F.when(given, trace)).alias("low"),
        F.max(F.when(given, trace)).alias("high"),
        F.bool_or(given & ~F.coalesce(fit, F.lit(False))).alias("unfit"),
    )

    def outside(t: str) -> Column:
        return (F.col(f"{t}.left") != F.col("left")) | (F.col(f"{t}.right") != F.col("right"))

    problem = F.when(F.col("unfit"), "range").when(outside("low") | outside("high"), "outside").when(F.col("low") != F.col("high"), "conflict")
    return own.where("n = 2").select("group_id", "left", "right", "low.hamming", "low.l_quality", "low.r_quality", problem.alias("problem"))


def ready_scores(pairs: DataFrame, features: DataFrame, final: bool, t: Thresholds = G) -> DataFrame:
    """Verdicts of pairs (left, right) by features (content, parts, hist): those that are ready, or with `final` all.

    A pair is ready once both sides have parts and a histogram; at the final barrier the others are inconclusive.
    """
    side = {k: features.select(F.col("content").alias(k), F.col("parts").alias(f"{k}_parts"), F.col("hist").alias(f"{k}_hist")) for k in ("left", "right")}
    rows = pairs.select("left", "right").join(side["left"], "left", "left").join(side["right"], "right", "left")
    columns = [F.col(c) for c in ("left_parts", "right_parts", "left_hist", "right_hist")]
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull()
    verdict = F.when(~whole, "inconclusive").otherwise(image_stage2(*columns, t))
    return rows.where(F.lit(final) | whole).select("left", "right", verdict.alias("verdict"))


def rescored(pairs: DataFrame, batches: Iterable[DataFrame], t: Thresholds = G) -> DataFrame:
    """left, right, verdict and round of all pairs, while features (content, parts, hist) arrive batch by batch (C17).

    A batch makes ready only pairs that touch it, so a round looks at those alone. Scores, features and the pairs that still wait
    are written each round. After the last batch comes the barrier, with the last round's number. A content's later
    features fill what its earlier ones lack.
    """
    where = shared_dir(pairs)
    waiting = written(pairs.select("left", "right").distinct(), f"{where}/waiting0")
    known, scores, n = None, [], 0
    for batch in batches:
        new = batch.select("content", "parts", "hist")
        every = new if known is None else known.unionByName(new)
        known = written(every.groupBy("content").agg(F.max("parts").alias("parts"), F.max("hist").alias("hist")), f"{where}/features{n}")
        came = new.select("content").distinct()
        touched = waiting.join(came.withColumnRenamed("content", "left"), "left", "left_semi").union(
            waiting.join(came.withColumnRenamed("content", "right"), "right", "left_semi").select("left", "right")
        ).distinct()
        done = written(ready_scores(touched, known, False, t).withColumn("round", F.lit(n)), f"{where}/scores{n}")
        scores.append(done)
        n += 1
        waiting = written(waiting.join(done, ["left", "right"], "left_anti"), f"{where}/waiting{n}")
    if known is None:
        return waiting.withColumn("verdict", F.lit("inconclusive")).withColumn("round", F.lit(0))
    out = ready_scores(waiting, known, True, t).withColumn("round", F.lit(n))
    for done in scores:
        out = out.unionByName(done)
    return out


def stage2_plan(sources: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """content, action and mask of slots: what stage 2 reuses, imports or computes for each content.

    sources: content, kind, slots (a mask; images have slot 0). local: content, base_complete, stage1 and stage2 masks.
    remote: content, stage2 (a mask of usable slots). Actions: incomplete_base (no local record, an incomplete one, no
    slot with stage 1, or another kind), republish what is there, import what the remote side has, compute the rest.
    """
    rows = sources.join(local.select("content", "base_complete", "stage1", F.col("stage2").alias("here")), "content", "left")
    rows = rows.join(remote.select("content", F.col("stage2").alias("there")), "content", "left")
    zero = F.lit(0)
    eligible = F.col("slots").bitwiseAND(F.coalesce("stage1", zero))
    usable = F.coalesce("base_complete", F.lit(False)) & F.col("kind").isin("image", "video") & (eligible != 0)
    existing = eligible.bitwiseAND(F.coalesce("here", zero))
    missing = eligible.bitwiseXOR(existing)
    imported = missing.bitwiseAND(F.coalesce("there", zero))
    plan = [("republish", existing), ("import", imported), ("compute", missing.bitwiseXOR(imported))]
    actions = F.array(*[F.struct(F.lit(name).alias("action"), mask.cast("int").alias("mask")) for name, mask in plan])
    none = F.array(F.struct(F.lit("incomplete_base").alias("action"), F.lit(0).alias("mask")))
    out = rows.select("content", F.explode(F.when(usable, F.filter(actions, lambda a: a["mask"] != 0)).otherwise(none)).alias("a"))
    return out.select("content", "a.action", "a.mask")


def duplicate_sources(sources: DataFrame) -> DataFrame:
    """Contents that a batch of sources names more than once, which stops its freezing."""
    return sources.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def single_flight(requests: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """job, keys, role and owner: each key is computed by one job at a time, in order of the jobs.

    requests: job, the keys, ok (whether the job's own attempt would succeed). Cached keys answer at once; else the first
    job owns the flight and the others wait; when it fails, the next waiter owns it; after a success the rest reuse it.
    """
    winner = requests.groupBy(*keys).agg(F.min(F.when(F.col("ok"), F.col("job"))).alias("owner"))
    answers = winner.join(cached.select(*keys, F.lit(True).alias("cached")).distinct(), keys, "left")
    rows = requests.join(answers, keys)
    role = F.when(F.col("cached"), "cached").when(F.col("owner").isNull() | (F.col("job") < F.col("owner")), "failed").when(F.col("job") == F.col("owner"), "owner").otherwise("reused")
    return rows.select("job", *keys, role.alias("role"), F.when(role.isin("owner", "reused"), F.col("owner")).alias("owner"))


def revision_gate(runs: DataFrame, revisions: DataFrame) -> DataFrame:
    """runs (run, library, revision, task, selected) with state: valid, or why results are blocked.

    A run selects exactly the current scan's task, and the library's revision is still the one that was analysed.
    """
    now = revisions.select("library", F.col("revision").alias("actual"))
    one = (F.size("selected") == 1) & (F.col("selected")[0] == F.col("task"))
    state = F.when(~F.coalesce(one, F.lit(False)), "task_mismatch").when(F.col("actual").eqNullSafe(F.col("revision")), "valid").otherwise("revision_changed")
    return runs.join(now, "library", "left").select("run", "library", "revision", "actual", state.alias("state"))


def finalised(items: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """Per task: items ok, failed, uncertain, pending and late reports, with the tasks' deadlines in force.

    items: task, item, deadline. reports: item, at, ok. The first report of an item in time counts; later ones and those
    after the deadline are dropped. When `now` has passed the deadline, items without one are failed and uncertain.
    """
    r = items.join(reports, "item", "left")
    in_time = F.col("at") <= F.col("deadline")
    own = r.groupBy("task", "item", "deadline").agg(
        F.min_by("ok", F.when(in_time, F.col("at"))).alias("ok"),
        F.count_if(~in_time).alias("late"),
    )
    over = now >= F.col("deadline")
    lost = F.col("ok").isNull()
    out = own.groupBy("task").agg(
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok") | (lost & over)).alias("failed"),
        F.count_if(lost & over).alias("uncertain"),
        F.count_if(lost & ~over).alias("pending"),
        F.sum("late").cast("long").alias("late"),
    )
    return out.withColumn("complete", F.col("pending") == 0)


def applied_batch(contents: DataFrame, files: DataFrame, cursors: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """contents, files, cursors and orphans after a batch of changes: contents are applied before what refers to them.

    batch: seq, machine, record (content, file, tombstone or another), content, path, active. Contents (content, seq) are
    kept by their first change, files (machine, path, content, active, seq) by their last one. Tombstones are read and
    change nothing: a file's own active = false is the fact. Files whose content nobody knows are orphans. Cursors
    (machine, committed) take every change's number and never go back.
    """
    new = batch.where("record = 'content'").select("content", "seq")
    known = contents.unionByName(new).groupBy("content").agg(F.min("seq").alias("seq"))
    rows = batch.where("record = 'file'").select("machine", "path", "content", "active", "seq")
    good = rows.join(known.select("content"), "content", "left_semi").select(*rows.columns)
    last = F.max_by(F.struct("content", "active"), "seq").alias("s")
    state = files.unionByName(good).groupBy("machine", "path").agg(last, F.max("seq").alias("seq"))
    state = state.select("machine", "path", "s.content", "s.active", "seq")
    ends = cursors.unionByName(batch.select("machine", F.col("seq").alias("committed"))).groupBy("machine").agg(F.max("committed").alias("committed"))
    return known, state, ends, rows.join(known.select("content"), "content", "left_anti").select(*rows.columns)


def enqueued(outbox: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outbox with new events, and the refused ones: (topic, entity, generation) is unique, and what is there stays.

    Both have topic, entity, generation, payload and at. Refused are empty topics or entities, negative generations and
    payloads that aren't JSON.
    """
    valid = (F.col("topic") != "") & (F.col("entity") != "") & (F.col("generation") >= 0) & F.expr("try_parse_json(payload) IS NOT NULL")
    ok = F.coalesce(valid, F.lit(False))
    first = F.struct("late", "at", "payload")
    both = outbox.withColumn("late", F.lit(False)).unionByName(events.where(ok).withColumn("late", F.lit(True)))
    kept = both.groupBy("topic", "entity", "generation").agg(F.min(first).alias("f"))
    return kept.select("topic", "entity", "generation", "f.payload", "f.at"), events.where(~ok)


def pruned(queue: DataFrame, poison: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """The queue without the poisoned entries of exactly the named generations; newer ones of the same keys stay."""
    return queue.join(poison.select(*keys, generation).distinct(), [*keys, generation], "left_anti")


def committed_reviews(groups: DataFrame, members: DataFrame, inconclusive: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted reviews, materialised members and refused reviews.

    groups: group_id. members: group_id, file_id. inconclusive: group_id, left, right, pairs that become groups only when
    they are reviewed. reviews: group_id, file_id, mark, at. A review needs an existing or synthetic group, a file of it
    and one of the marks; the last of a group's file counts.
    """
    made = inconclusive.join(groups, "group_id", "left_anti").join(reviews.select("group_id").distinct(), "group_id", "left_semi")
    made = made.select("group_id", F.explode(F.array("left", "right")).alias("file_id"))
    all_members = members.select("group_id", "file_id").unionByName(made).distinct()
    marked = F.col("mark").isin("keep", "delete", "undecided")
    rows = reviews.join(all_members.withColumn("is_member", F.lit(True)), ["group_id", "file_id"], "left")
    ok = F.coalesce(marked & F.col("is_member"), F.lit(False))
    accepted = rows.where(ok).groupBy("group_id", "file_id").agg(F.max_by("mark", F.struct("at", "mark")).alias("mark"))
    return accepted, made, rows.where(~ok).select(*reviews.columns)


def without_tasks(tables: dict[str, DataFrame], tasks: DataFrame, key: str = "task") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of deleted tasks, and the receipt: task, table and rows that went."""
    gone = tasks.select(key).distinct()
    receipt = None
    for name, rows in tables.items():
        own = rows.join(gone, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit(name).alias("table"), "n")
        receipt = own if receipt is None else receipt.unionByName(own)
    return {name: rows.join(gone, key, "left_anti") for name, rows in tables.items()}, receipt


def missing_mask(columns: list[str]) -> Column:
    """Bit i is set where column i is null."""
    mask = F.lit(0)
    for i, c in enumerate(columns):
        mask = mask.bitwiseOR(F.when(F.col(c).isNull(), 1 << i).otherwise(0))
    return mask


def complete_videos(slots: DataFrame, needed: int = 6, least: int = 4) -> DataFrame:
    """video_id and n_decoded of videos with all slot rows, enough decoded ones, and stage 2 on every decoded one."""
    own = slots.groupBy("video_id").agg(
        F.count_distinct("slot").alias("n"), F.count_if("decoded").alias("n_decoded"), F.count_if(F.col("decoded") & ~F.col("stage2")).alias("n_lacking")
    )
    return own.where((F.col("n") == needed) & (F.col("n_decoded") >= least) & (F.col("n_lacking") == 0)).select("video_id", "n_decoded")
