"""The capture gate over frame sequences, by windows.

A frame belongs to a run while its box hardly differs from the box before; a
run of three with two consecutive eligible frames fires, once a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g
from . import folds

# Frames needed, and frames remembered for the best one.
STABLE, FOCUSED, RING = 3, 2, 8


def decisions(frames: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """``frames`` (box struct or null, is_sharp, is_adjusting and, if there,
    is_settling) with run, counts and the decision: should_capture, is_stable,
    is_eligible, did_reset.  All are false after the capture.  Frames with an
    ``error`` don't belong here, see ``split_errors``."""
    w = Window.partitionBy(session).orderBy(seq)
    before = F.lag("box").over(w)
    rows = frames.withColumn("__before", before).withColumn("__steady", F.coalesce(g.stable(F.col("box"), F.col("__before")), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("__steady"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(session, "run").orderBy(seq)
    there = F.col("box").isNotNull()
    moving = F.coalesce(F.col("is_adjusting"), F.lit(False))
    if "is_settling" in frames.columns:
        moving = moving | F.coalesce(F.col("is_settling"), F.lit(False))
    eligible = there & F.coalesce(F.col("is_sharp"), F.lit(True)) & ~moving
    rows = rows.withColumn("stable_count", F.when(there, F.row_number().over(inside)).otherwise(0)).withColumn("__eligible", eligible)
    rows = rows.withColumn("__break", F.sum(F.when(F.col("__eligible"), 0).otherwise(1)).over(inside))
    streak = Window.partitionBy(session, "run", "__break").orderBy(seq)
    rows = rows.withColumn("focused_count", F.when(F.col("__eligible"), F.sum(F.when(F.col("__eligible"), 1).otherwise(0)).over(streak)).otherwise(0).cast("int"))
    rows = rows.withColumn("__stable", F.col("stable_count") >= STABLE).withColumn("__fires", F.col("__stable") & (F.col("focused_count") >= FOCUSED))
    fired = F.coalesce(F.sum(F.when(F.col("__fires"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__live", fired == 0)
    reset = ~there | (F.col("__before").isNotNull() & ~F.col("__steady"))
    live = F.col("__live")
    return rows.select(
        *frames.columns, "run", "stable_count", "focused_count", (live & F.col("__fires")).alias("should_capture"), (live & F.col("__stable")).alias("is_stable"),
        (live & F.col("__eligible")).alias("is_eligible"), (live & F.coalesce(reset, F.lit(False))).alias("did_reset"),
    )


def best_frames(gated: DataFrame, session: str = "session_id", seq: str = "seq", score: str = "score") -> DataFrame:
    """For each capture the best of the last RING sharp frames of its run up to
    it: the highest score, the earliest of equals.  A frame of unknown sharpness
    may fire but isn't remembered; a capture without a sharp frame gives no row."""
    sharp = F.col("box").isNotNull() & F.coalesce(F.col("is_sharp"), F.lit(False))
    rows = gated.withColumn("__sharp", sharp)
    recent = Window.partitionBy(session, "run", "__sharp").orderBy(seq).rowsBetween(1 - RING, 0)
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(seq)).alias("back"))).over(recent)
    rows = rows.withColumn("__best", F.when(F.col("__sharp"), best))
    so_far = Window.partitionBy(session, "run").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    picked = rows.withColumn("__best", F.last("__best", ignorenulls=True).over(so_far)).where("should_capture and __best is not null")
    return picked.select(session, F.col(seq).alias("capture_seq"), (-F.col("__best.back")).alias("best_seq"), F.col("__best.score").alias("best_score"))


def scanner_state(reason, is_stable):
    """The state that a frame with a detection leads to."""
    return (
        F.when(reason == "tooCloseLikely", "moveFartherAway").when(reason.isin("tooDark", "tooLowContrast"), "moreLightNeeded")
        .when(reason == "waitingForAutofocus", "holdingSteady").when((reason == "tooBlurry") & is_stable, "holdingSteady").otherwise("running")
    )


def split_errors(frames: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Frames for the gate, and those whose detection or crop failed: the
    latter leave the gate as it is and are reported on their own."""
    return frames.where(F.col(error).isNull()), frames.where(F.col(error).isNotNull())


def on_time(frames: DataFrame, session: str = "session_id", seq: str = "seq", arrived: str = "arrived", done: str = "done") -> DataFrame:
    """Frames that find the analysis free: one that arrives while the frame
    taken before it is still being analysed is dropped.  ``done`` is when a
    frame's analysis would end.  Which frame was taken depends on all before,
    so this is a fold over the session's rows."""
    return folds.scan(frames, [session], [seq], folds.free_step, (None,), {"t": arrived, "until": done}, "taken boolean").where("taken").drop("taken")
