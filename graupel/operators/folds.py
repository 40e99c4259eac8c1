"""Ordered folds: operators whose state depends on the rows before.

``scan`` runs a step function over each key's rows in order.  Rows are dealt by
key and sorted within the partitions, then pass through batch by batch with the
key's state carried along, so a key of any size needs the memory of one batch.
The same step functions drive the streaming versions.
"""

from __future__ import annotations

from collections.abc import Callable
from math import hypot, isfinite

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions import text as t

# Intervals in seconds and distances of throttle and refocus.
THROTTLE, REFOCUS, SETTLING, DRIFT, BLURRY_FRAMES = 0.25, 0.80, 0.60, 0.08, 2


def scan(df: DataFrame, key: list[str], order: list[str], step: Callable, start: tuple, take: dict[str, str], into: str) -> DataFrame:
    """``df`` with the columns of ``into`` (a DDL list): what
    ``step(state, *values) -> (state, results)`` returns for each row, where the
    values are those of the columns that ``take`` names."""
    names = [part.split()[0] for part in into.split(", ")]
    kinds = [{"boolean": pa.bool_(), "int": pa.int32()}[part.split()[1]] for part in into.split(", ")]
    keep = df.columns
    cut = df.select("*", F.struct(*(F.col(c) for c in key)).alias("__key"), *(F.col(c).alias(f"__{n}") for n, c in take.items()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + into

    def run(batches):
        last, state = None, start
        for batch in batches:
            columns = [batch.column(f"__{n}").to_pylist() for n in take]
            keys, fresh = changes(batch.column("__key"), last)
            out = []
            for values, new in zip(zip(*columns), fresh):
                if new:
                    state = start
                state, results = step(state, *values)
                out.append(results)
            last = keys
            found = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, *names])

    return cut.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def changes(keys: pa.StructArray, last) -> tuple[object, list[bool]]:
    """The last key of a batch, and at which rows a new key begins; ``last`` is
    the key before the batch."""
    n = len(keys)
    if not n:
        return last, []
    new = np.zeros(n, bool)
    for part in keys.flatten():
        a, b = part[1:], part[:-1]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False).astype(bool)
    new[0] = last is None or keys[0].as_py() != last
    return keys[n - 1].as_py(), new.tolist()


def throttle_step(state: tuple, t: float) -> tuple[tuple, tuple]:
    """Accepts the first row, then one at least THROTTLE after the last accepted."""
    ok = state[0] is None or t - state[0] >= THROTTLE
    return ((t,) if ok else state), (ok,)


def refocus_step(state: tuple, t: float, px: float, py: float, reason: str) -> tuple[tuple, tuple]:
    """Requests focus where the point moved or frames stay blurry, not sooner
    than REFOCUS after the last request; also whether that is settling."""
    at, x, y, blurry = state
    moved = x is None or hypot(px - x, py - y) >= DRIFT
    blurry = blurry + 1 if reason in ("tooBlurry", "tooCloseLikely") else 0
    asked = (moved or blurry >= BLURRY_FRAMES) and (at is None or t - at >= REFOCUS)
    if asked:
        at, x, y, blurry = t, px, py, 0
    return (at, x, y, blurry), (asked, at is not None and t - at < SETTLING)


def free_step(state: tuple, t: float, until: float) -> tuple[tuple, tuple]:
    """Takes a row that comes when the one taken before is done."""
    ok = state[0] is None or t >= state[0]
    return ((until,) if ok else state), (ok,)


REFOCUS_COLUMNS = {"t": "t", "px": "px", "py": "py", "reason": "reason"}


def resettable(step: Callable, start: tuple, width: int) -> Callable:
    """A step that takes one value more, first: a true one is no row of its own
    but puts the state back to ``start``, and has null results."""

    def run(state: tuple, again: bool | None, *values) -> tuple[tuple, tuple]:
        return (start, (None,) * width) if again else step(state, *values)

    return run


def throttle(df: DataFrame, key: list[str], order: list[str], reset: str | None = None) -> DataFrame:
    """``df`` (with t in seconds) and whether each row is accepted; a row whose
    ``reset`` column is true begins anew."""
    if reset:
        return scan(df, key, order, resettable(throttle_step, (None,), 1), (None,), {"reset": reset, "t": "t"}, "accepted boolean")
    return scan(df, key, order, throttle_step, (None,), {"t": "t"}, "accepted boolean")


def refocus(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` (t, px, py, reason) with ``requested`` and ``settling``."""
    return scan(df, key, order, refocus_step, (None, None, None, 0), REFOCUS_COLUMNS, "requested boolean, settling boolean")


def _iou(a: tuple, b: tuple) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common = w * h if w > 0 and h > 0 else 0.0
    union = a[2] * a[3] + b[2] * b[3] - common
    return common / union if union > 0 else 0.0


def merge_step(state: list, x: float, y: float, w: float, h: float, confidence: float | None) -> tuple[list, tuple]:
    """The slot that a box falls into, and whether it takes the slot over."""
    box = (x, y, w, h)
    for slot, (other, best) in enumerate(state):
        if _iou(other, box) >= 0.35:
            better = confidence is not None and (best is None or confidence > best)
            if better:
                state = [*state[:slot], (box, confidence), *state[slot + 1 :]]
            return state, (slot, better)
    return [*state, (box, confidence)], (len(state), True)


def deduplicated(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Observations (text_key, confidence, x, y, w, h and, if there,
    candidates) of each key, in order: one merges into the first accepted one of
    the same text that it overlaps by 0.35 or more, and replaces it in place if
    its confidence is higher.  Returns the accepted ones with ``place`` (from 0
    in the order of each key), ``merged`` (how many fell together) and, of the
    candidates (array<struct<text, ...>>), the union, the better observation's
    first, each text once by its normal form.

    Only rows of one key and text can merge, so the fold is dealt by both and
    only names each row's slot; the best row of a slot and the place of the slot
    in the key follow by windows."""
    by = [*key, "text_key"]
    rows = df.where("text_key is not null and text_key <> ''")
    slots = scan(rows, by, order, merge_step, [], {n: n for n in ("x", "y", "w", "h", "confidence")}, "slot int, replaces boolean")
    w = Window.partitionBy(*by, "slot")
    found = slots.withColumn("__nth", F.row_number().over(w.orderBy(*order))).withColumn("__best", F.row_number().over(w.orderBy(F.col("confidence").desc_nulls_last(), *order)))
    found = found.withColumn("merged", F.count("*").over(w).cast("int")).withColumn("__begun", F.min(F.struct(*order)).over(w))
    if "candidates" in df.columns:
        # who takes the slot over puts the own candidates before the rest, others behind
        turn = F.when(F.col("replaces"), -F.col("__nth")).otherwise(F.col("__nth"))
        every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), "candidates")).over(w)), lambda x: x["candidates"]))
        found = found.withColumn("__every", every).where("__best = 1")
        found = found.withColumn("candidates", F.when(F.col("merged") == 1, F.col("candidates")).otherwise(unique_candidates(F.col("__every"))))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("__begun", "text_key")) - 1
    return found.where("__best = 1").withColumn("place", place).select(*df.columns, "place", "merged")


def unique_candidates(candidates: Column) -> Column:
    """Candidates (array<struct<text, confidence>>) with each text once by its
    normal form (``text.observation_key``), the first of equals, in order.
    Compatibility forms of all texts of a batch are made at once."""
    keys = F.transform(t.nfkc_each(F.transform(candidates, lambda c: c["text"])), lambda k: F.lower(t.squeezed(k)))
    both = F.struct(keys.alias("keys"), candidates.alias("c"))  # one value, as a lambda can't hold a Python function

    def first_of_each(v: Column) -> Column:
        zipped = F.arrays_zip(v["keys"].alias("key"), v["c"].alias("c"))
        return F.transform(F.filter(zipped, lambda x, i: F.array_position(v["keys"], F.coalesce(x["key"], F.lit(""))) == i + 1), lambda x: x["c"])

    return t.bound(both, first_of_each)


def before(a: tuple, b: tuple) -> bool:
    """Whether the box with (middle, x) ``a`` is read before ``b``: higher by
    more than 0.025, else further left; no null is before anything.  NaN is the
    largest number, as in SQL."""
    (p, x), (q, y) = a, b
    if p is None or q is None:
        return False
    apart = abs(p - q)
    if apart > 0.025 or apart != apart:
        return p > q or (p != p and q == q)
    return x is not None and y is not None and (x < y or (y != y and x == x))


def reading_order(places: list[tuple]) -> list[int]:
    """The positions of boxes, each given as (middle, x), from top to bottom,
    lines (middles within 0.025) from left to right.

    Being within 0.025 isn't transitive, so boxes that drift have no one order
    by it, and a sort may refuse the comparison.  Here each item goes, in the
    given order, behind the last one that it isn't before: the order of an
    insertion sort, which is defined for any comparison and is the sorted one
    wherever there is one.  Where the middles fall into lines that are clearly
    apart, it is that of a stable sort, which is made instead."""
    if all(m is not None and x is not None and isfinite(m) and isfinite(x) for m, x in places):
        line, first, last = {}, None, None
        for m in sorted({m for m, _ in places}, reverse=True):
            if last is None or last - m > 0.025:
                first = m
            elif first - m > 0.025:
                break  # a line that drifts
            line[m], last = -first, m
        else:
            return sorted(range(len(places)), key=lambda i: (line[places[i][0]], places[i][1]))
    done: list[int] = []
    for i, place in enumerate(places):
        at = len(done)
        while at and before(place, places[done[at - 1]]):
            at -= 1
        done.insert(at, i)
    return done


@F.arrow_udf(StringType())
def combined_text(items: pa.Array) -> pa.Array:
    """The texts of an array of struct<text, x, y, w, h> in reading order, a
    line each; null texts are left out."""
    flat = items.flatten()
    text, x, y, h = (pc.struct_field(flat, n) for n in ("text", "x", "y", "h"))
    middle, x, text = pc.add(y, pc.divide(h, 2.0)).to_pylist(), x.to_pylist(), text.to_pylist()
    out, at = [], 0
    for n in pc.list_value_length(items).to_pylist():
        if n is None:
            out.append(None)
            continue
        order = reading_order(list(zip(middle[at : at + n], x[at : at + n])))
        out.append("\n".join(t for i in order if (t := text[at + i]) is not None))
        at += n
    return pa.array(out, pa.string())
