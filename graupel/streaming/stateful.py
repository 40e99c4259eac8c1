"""The ordered folds and the capture gate as Structured Streaming operators.

State is kept per key between micro-batches, in the session's RocksDB store, which
``spark.sql.streaming.stateStore.providerClass`` must name; rows of a micro-batch
are put in the order of ``seq``.  The folds' state ends after a time of silence,
by the clock; as such operators make Spark run batches without data on and on, a
query that is to end (``availableNow``) needs
``spark.sql.streaming.noDataMicroBatches.enabled=false``.  With the same rows in
the same order the results are those of the batch operators.
"""

from __future__ import annotations

from collections import deque
from math import hypot

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.folds import REFOCUS_COLUMNS, free_step, refocus_step, resettable, throttle_step
from ..operators.gate import FOCUSED, RING, STABLE


def frames(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Landed frames as a stream, ``files`` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


class Fold(StatefulProcessor):
    """A step of ``operators.folds`` over the rows of a key: each micro-batch's
    rows in the order of ``seq``, the state kept between them.  A key that is
    silent for ``idle`` seconds loses its state and begins anew."""

    def __init__(self, step, start: tuple, take: list[str], names: list[str], state: str, seq: str, idle: float):
        self.step, self.start, self.take, self.names, self.state, self.seq, self.idle = step, start, take, names, state, seq, idle

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", self.state, int(self.idle * 1000))

    def handleInputRows(self, key, rows, timer_values):
        now = tuple(self.kept.get()) if self.kept.exists() else self.start
        now = tuple(None if isinstance(v, float) and v != v else v for v in now)
        batch = pd.concat([*rows]).sort_values(self.seq, kind="stable")
        out = []
        for values in zip(*(batch[c].tolist() for c in self.take)):
            now, results = self.step(now, *values)
            out.append(results)
        self.kept.update(now)
        yield batch.assign(**{n: pd.Series([v[i] for v in out], batch.index, object) for i, n in enumerate(self.names)})

    def close(self) -> None:
        pass


#: Seconds after which a silent key's state ends.
IDLE = 3600.0


def _folded(stream: DataFrame, key: list[str], seq: str, step, start: tuple, take: list[str], into: str, state: str, idle: float) -> DataFrame:
    names = [part.split()[0] for part in into.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", " + into
    return stream.groupBy(*key).transformWithStateInPandas(Fold(step, start, take, names, state, seq, idle), schema, "Append", "ProcessingTime")


def throttle(stream: DataFrame, key: list[str], seq: str = "seq", reset: str | None = None, idle: float = IDLE) -> DataFrame:
    step = resettable(throttle_step, (None,), 1) if reset else throttle_step
    return _folded(stream, key, seq, step, (None,), [reset, "t"] if reset else ["t"], "accepted boolean", "last double", idle)


def refocus(stream: DataFrame, key: list[str], seq: str = "seq", idle: float = IDLE) -> DataFrame:
    return _folded(stream, key, seq, refocus_step, (None, None, None, 0), [*REFOCUS_COLUMNS.values()], "requested boolean, settling boolean", "at double, x double, y double, blurry long", idle)


def on_time(stream: DataFrame, key: list[str], seq: str = "seq", arrived: str = "arrived", done: str = "done", idle: float = IDLE) -> DataFrame:
    """Rows that arrive when the one taken before, in whatever micro-batch, is
    ``done``; the others are dropped."""
    return _folded(stream, key, seq, free_step, (None,), [arrived, done], "taken boolean", "busy double", idle).where("taken").drop("taken")


def _steady(a: tuple, b: tuple) -> bool:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common, one, two = (w * h if w > 0 and h > 0 else 0.0), a[2] * a[3], b[2] * b[3]
    union, larger = one + two - common, max(one, two)
    near = hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2) <= 0.06
    return near and union > 0 and common / union >= 0.65 and (abs(one - two) / larger if larger > 0 else 1.0) <= 0.25


GATE = "seq long, should_capture boolean, is_stable boolean, is_eligible boolean, did_reset boolean, best_seq long, best_score double"


def gate_step(state: dict, seq: int, box: tuple | None, sharp: bool, known: bool, moving: bool, score: float) -> tuple:
    """One frame through the gate; ``state`` holds the box before, the counts,
    whether it has fired, and the ring of frames ``known`` to be sharp."""
    fired = state["fired"]
    if box is None:
        state.update(before=None, stable=0, focused=0)
        state["ring"].clear()
        return seq, False, False, False, not fired, None, None
    before = state["before"]
    if before is not None and _steady(box, before):
        state["stable"] += 1
        reset = False
    else:
        state.update(stable=1, focused=0)
        reset = before is not None
    if reset:
        state["ring"].clear()
    eligible = sharp and not moving
    state["focused"] = state["focused"] + 1 if eligible else 0
    state["before"] = box
    if known:
        state["ring"].append((seq, score))
    if fired:
        return seq, False, False, False, False, None, None
    stable = state["stable"] >= STABLE
    fires = stable and state["focused"] >= FOCUSED
    best = None
    if fires:
        state["fired"] = True
        best = max(state["ring"], key=lambda x: (x[1], -x[0]), default=None)
    return (seq, fires, stable, eligible, reset, *(best or (None, None)))


class CaptureGate(StatefulProcessor):
    """The gate and its ring of best frames, one state a session."""

    def init(self, handle) -> None:
        self.gate = handle.getValueState("gate", "x double, y double, w double, h double, stable int, focused int, fired boolean")
        self.ring = handle.getListState("ring", "seq long, score double")

    def handleInputRows(self, key, rows, timer_values):
        state = {"before": None, "stable": 0, "focused": 0, "fired": False, "ring": deque(maxlen=RING)}
        if self.gate.exists():
            x, y, w, h, state["stable"], state["focused"], state["fired"] = self.gate.get()
            state["before"] = None if x is None or x != x else (x, y, w, h)
        if self.ring.exists():
            state["ring"].extend((int(a), float(b)) for a, b in self.ring.get())
        batch = pd.concat([*rows]).sort_values("seq", kind="stable")
        out = []
        for seq, there, x, y, w, h, sharp, known, moving, score in zip(*(batch[c].tolist() for c in ("seq", "there", "x", "y", "w", "h", "is_sharp", "known", "moving", "score"))):
            out.append(gate_step(state, seq, (x, y, w, h) if there else None, bool(sharp), bool(known), bool(moving), score))
        self.gate.update((*(state["before"] or (None,) * 4), state["stable"], state["focused"], state["fired"]))
        self.ring.put([*state["ring"]]) if state["ring"] else self.ring.clear()
        names = [part.split()[0] for part in GATE.split(", ")]
        found = pd.DataFrame(out, columns=names).astype({"best_seq": "Int64", "best_score": "float64"})
        found.insert(0, "session_id", key[0])
        yield found

    def close(self) -> None:
        pass


def gate(stream: DataFrame, session: str = "session_id", seq: str = "seq", score: str = "score") -> DataFrame:
    """The capture gate on a stream of frames (box struct or null, is_sharp,
    is_adjusting): the decision of each frame, and with a capture the best of
    the last sharp frames.  Frames with an ``error`` pass by the state; null
    means sharp for the gate, though not for the ring, and not adjusting."""
    kind = stream.schema[session].dataType.simpleString()
    if "error" in stream.columns:
        stream = stream.where("error is null")
    flag = lambda c, missing: F.coalesce(F.col(c), F.lit(missing))
    moving = flag("is_adjusting", False)
    if "is_settling" in stream.columns:
        moving = moving | flag("is_settling", False)
    cut = stream.select(
        F.col(session).alias("session_id"), F.col(seq).cast("long").alias("seq"), F.col("box").isNotNull().alias("there"),
        *(F.coalesce(F.col(f"box.{n}"), F.lit(0.0)).alias(n) for n in "xywh"), flag("is_sharp", True).alias("is_sharp"), flag("is_sharp", False).alias("known"), moving.alias("moving"), F.col(score).cast("double").alias("score"),
    )
    return cut.groupBy("session_id").transformWithStateInPandas(CaptureGate(), f"session_id {kind}, {GATE}", "Append", "None").withColumnRenamed("session_id", session)
