"""Scores and verdicts of candidate pairs: stage 1 and 2 of images, slots of videos, with explicit "inconclusive"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemello.functions.hashing import cosine, cosine_r
from gemello.operators.config import G, R, Thresholds


def canonical(pairs: DataFrame, left: str, right: str, swapped: tuple[str, str] = ("l_quality", "r_quality")) -> DataFrame:
    """Pairs with the smaller key left; the qualities change sides with their keys."""
    turn = F.col(left) > F.col(right)
    a, b = swapped
    qualities = [F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a), F.when(turn, F.col(a)).otherwise(F.col(b)).alias(b)]
    rest = [c for c in pairs.columns if c not in (left, right, a, b)]
    return pairs.select(F.least(left, right).alias(left), F.greatest(left, right).alias(right), *qualities, *rest)


def stage1_score(distance: Column) -> Column:
    return 1 - distance / 256


def passed_parts(a: Column, b: Column, most: int) -> Column:
    """How many of the parts differ in at most `most` bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (F.bit_count(x.bitwiseXOR(y)) <= most).cast("int")), F.lit(0), lambda s, n: s + n)


def image_stage2(a_parts: Column, b_parts: Column, a_hist: Column, b_hist: Column, t: Thresholds = G) -> Column:
    """Verdict yes, no or inconclusive: enough near parts, then a near enough gradient histogram; without parts or histograms inconclusive."""
    parts = passed_parts(a_parts, b_parts, t.part_bits)
    near = cosine(a_hist, b_hist) >= t.sobel
    verdict = F.when(a_parts.isNull() | b_parts.isNull(), "inconclusive").when(parts < t.parts, "no")
    return verdict.when(a_hist.isNull() | b_hist.isNull(), "inconclusive").when(near, "yes").otherwise("no")


def image_stage2_r(a_parts: Column, b_parts: Column, a_hist: Column, b_hist: Column, t: Thresholds = R) -> Column:
    """Verdict passed, rejected or incomplete; both tests are taken together, the histogram's in single precision."""
    unknown = a_parts.isNull() | b_parts.isNull() | a_hist.isNull() | b_hist.isNull()
    ok = (passed_parts(a_parts, b_parts, t.part_bits) >= t.parts) & (cosine_r(a_hist, b_hist) >= F.lit(t.sobel).cast("float"))
    return F.when(unknown, "incomplete").when(ok, "passed").otherwise("rejected")


def video_verdict(slots: DataFrame, similarity: str = "similarity", valid: str = "valid", t: Thresholds = G) -> DataFrame:
    """Per pair (left, right) of slot rows: valid and passed slots, the mean over valid ones and the verdict.

    A slot counts where both sides have the frame; a valid slot that failed has similarity 0. Fewer than video_frames
    valid slots are inconclusive and publish no mean.
    """
    own = slots.groupBy("left", "right").agg(
        F.sum(F.when(F.col(valid), 1).otherwise(0)).alias("n_valid"),
        F.sum(F.when(F.col(valid) & (F.col(similarity) > 0), 1).otherwise(0)).alias("n_passed"),
        F.sum(F.when(F.col(valid), F.col(similarity)).otherwise(0.0)).alias("total"),
    )
    enough = F.col("n_valid") >= t.video_frames
    mean = F.when(enough, F.col("total") / F.col("n_valid"))
    near = mean >= t.video_mean
    if t.count_rule:
        near = near | (F.col("n_passed") >= t.video_frames)
    return own.select("left", "right", "n_valid", "n_passed", mean.alias("mean"), F.when(~enough, "inconclusive").when(near, "yes").otherwise("no").alias("verdict"))


def video_stage(pairs: DataFrame, frames: DataFrame, key: str, phash: bool, t: Thresholds = G) -> DataFrame:
    """One stage's verdict of pairs (left, right) of videos (C05): left, right, n_valid, n_passed, mean, verdict and reason.

    frames: the key, slot (0 to 5), parts, hist and error (null or empty: none). A slot is valid if both sides have it
    without an error. The pHash stage takes the share of near parts, the other one the histograms' cosine; enough by the
    mean or by slots that pass is yes. Inconclusive are repeated or impossible slots, valid slots without what the stage
    reads, and too few valid slots, in this order; they publish no mean.
    """
    side = frames.select(F.col(key).alias("video"), "slot", F.col("parts" if phash else "hist").alias("x"), (F.coalesce("error", F.lit("")) == "").alias("fine"))
    wrong = side.groupBy("video").agg((F.max(F.coalesce(~F.col("slot").between(0, 5), F.lit(True))) | (F.count(F.lit(1)) > F.count_distinct("slot"))).alias("wrong"))
    a, b = (side.select(F.col("video").alias(k), "slot", F.col("x").alias(f"{k}_x"), F.col("fine").alias(f"{k}_fine")) for k in ("left", "right"))
    rows = pairs.select("left", "right").distinct().join(a, "left").join(b, ["right", "slot"]).where("left_fine and right_fine")
    lacks = F.col("left_x").isNull() | F.col("right_x").isNull()
    if phash:
        n = F.greatest(F.size("left_x"), F.lit(1))
        sim, bar, enough = passed_parts(F.col("left_x"), F.col("right_x"), t.part_bits) / n, F.lit(float(t.parts)) / n, "phash"
    else:
        sim, bar, enough = cosine(F.col("left_x"), F.col("right_x")), F.lit(t.sobel), "sobel"
    rows = rows.select("left", "right", "slot", lacks.alias("lacks"), F.when(~lacks, sim).alias("sim"), F.when(~lacks, bar).alias("bar"))
    own = rows.groupBy("left", "right").agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.count_if(F.col("sim") >= F.col("bar")).alias("n_passed"),
        F.sum("sim").alias("total"),
        F.max("bar").alias("bar"),
        F.bool_or("lacks").alias("lacks"),
    )
    out = pairs.select("left", "right").distinct().join(own, ["left", "right"], "left")
    for k in ("left", "right"):
        out = out.join(wrong.select(F.col("video").alias(k), F.col("wrong").alias(f"{k}_wrong")), k, "left")
    invalid = F.coalesce("left_wrong", F.lit(False)) | F.coalesce("right_wrong", F.lit(False))
    few = F.coalesce("n_valid", F.lit(0)) < t.video_frames
    reason = F.when(invalid, "invalid_frames").when(F.col("lacks"), f"invalid_{enough}").when(few, "insufficient_valid_frames")
    least = F.col("bar") if phash else F.lit(t.video_mean)
    mean = F.when(reason.isNull(), F.col("total") / F.col("n_valid"))
    yes = (mean >= least - 1e-12) | (F.col("n_passed") >= t.video_frames)
    verdict = F.when(reason.isNotNull(), "inconclusive").when(yes, "yes").otherwise("no")
    why = F.coalesce(reason, F.when(yes, f"{enough}_passed").otherwise(f"{enough}_below_threshold"))
    zero = F.lit(0).cast("long")
    return out.select("left", "right", F.coalesce("n_valid", zero).alias("n_valid"), F.coalesce("n_passed", zero).alias("n_passed"), mean.alias("mean"), verdict.alias("verdict"), why.alias("reason"))


def video_stages(pairs: DataFrame, frames: DataFrame, key: str, t: Thresholds = G) -> DataFrame:
    """left, right, verdict and reason: only pairs that pass the pHash stage are judged by histograms."""
    first = video_stage(pairs, frames, key, True, t).select("left", "right", "verdict", "reason")
    second = video_stage(first.where("verdict = 'yes'"), frames, key, False, t).select("left", "right", "verdict", "reason")
    return first.where("verdict <> 'yes'").unionByName(second)


def video_joint(slots: DataFrame, t: Thresholds = G) -> DataFrame:
    """Joint verdict of pairs (left, right) from slot rows with l_parts, r_parts, l_hist, r_hist and valid.

    A valid slot's similarity is its histograms' cosine if enough parts are near, else 0; it has passed if that cosine is
    near enough too. Fewer than video_frames valid slots are inconclusive and publish no mean.
    """
    near = F.coalesce(passed_parts(F.col("l_parts"), F.col("r_parts"), t.part_bits) >= t.parts, F.lit(False))
    sim = F.when(F.col("valid") & near, cosine(F.col("l_hist"), F.col("r_hist"))).otherwise(0.0)
    own = slots.withColumn("__near", near).withColumn("__sim", sim).groupBy("left", "right").agg(
        F.sum(F.col("valid").cast("int")).alias("n_valid"),
        F.sum((F.col("valid") & F.col("__near") & (F.col("__sim") >= t.sobel)).cast("int")).alias("n_passed"),
        F.sum("__sim").alias("total"),
    )
    enough = F.col("n_valid") >= t.video_frames
    mean = F.when(enough, F.col("total") / F.col("n_valid"))
    yes = (mean >= t.video_mean) | (F.col("n_passed") >= t.video_frames)
    return own.select("left", "right", "n_valid", "n_passed", mean.alias("mean"), F.when(~enough, "inconclusive").when(yes, "yes").otherwise("no").alias("verdict"))


def video_stage2_r(slots: DataFrame, t: Thresholds = R) -> DataFrame:
    """Stage 2 of pairs (left, right) from slot rows with slot, l_parts, r_parts, l_hist, r_hist and valid (C08), in single precision.

    The mean over valid slots of the cosine of those with enough near parts, whatever the cosine is. Too few valid slots,
    or one that lacks parts or a histogram on a side, make the pair incomplete.
    """
    lacks = F.col("l_parts").isNull() | F.col("r_parts").isNull() | F.col("l_hist").isNull() | F.col("r_hist").isNull()
    near = passed_parts(F.col("l_parts"), F.col("r_parts"), t.part_bits) >= t.parts
    zero = F.lit(0.0).cast("float")
    score = F.when(F.col("valid") & near, cosine_r(F.col("l_hist"), F.col("r_hist"))).otherwise(zero)
    own = slots.withColumn("__lacks", F.col("valid") & lacks).withColumn("__score", F.coalesce(score, zero)).groupBy("left", "right").agg(
        F.sum(F.col("valid").cast("int")).alias("n_valid"),
        F.bool_or("__lacks").alias("lacks"),
        F.sort_array(F.collect_list(F.struct("slot", "__score"))).alias("scores"),
    )
    total = F.aggregate("scores", zero, lambda s, x: (s + x["__score"]).cast("float"))
    complete = (F.col("n_valid") >= t.video_frames) & ~F.col("lacks")
    mean = F.when(complete, (total / F.col("n_valid")).cast("float"))
    verdict = F.when(~complete, "incomplete").when(mean >= F.lit(t.video_mean).cast("float"), "passed").otherwise("rejected")
    return own.select("left", "right", "n_valid", mean.alias("mean"), verdict.alias("verdict"))


def slot_pairs(pairs: DataFrame, frames: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs with the frames of both sides, slot by slot; a slot that a side lacks isn't valid."""
    a = frames.select(F.col(key).alias("left"), "slot", *[F.col(c).alias(f"l_{c}") for c in columns])
    b = frames.select(F.col(key).alias("right"), "slot", *[F.col(c).alias(f"r_{c}") for c in columns])
    return pairs.select("left", "right").join(a, "left").join(b, ["right", "slot"])
