"""Gate, throttle, refocus, ordered dedup, grids: batch and stream."""

import json
import os
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graupel.functions import geometry as g
from graupel.operators import folds, gate, grids
from graupel.plans import catalogue
from graupel.streaming import stateful

R, M, J, K, V = (0.20, 0.15, 0.36, 0.50), (0.34, 0.29, 0.36, 0.50), (0.215, 0.16, 0.37, 0.48), (0.205, 0.145, 0.35, 0.51), (0.19, 0.14, 0.39, 0.52)
FRAMES = {"R": (R, True, False), "N": (None, True, False), "B": (R, False, False), "A": (R, True, True), "M": (M, True, False), "J": (J, True, False), "K": (K, True, False), "V": (V, True, False)}
GATES = [
    ("RRR", "FFT"), ("RNRRR", "FFFFT"), ("RRRRR", "FFTFF"), ("RRMMM", "FFFFT"), ("RJK", "FFT"), ("RVR", "FFT"), ("BBBB", "FFFF"), ("BRR", "FFT"), ("RAARR", "FFFFT"),
]


def frames(spark, sequences):
    rows = [(k, i, *(b or (None,) * 4), sharp, adj) for k, seq in enumerate(sequences) for i, (b, sharp, adj) in enumerate(FRAMES[c] for c in seq)]
    df = spark.createDataFrame(rows, "session_id int, seq int, x double, y double, w double, h double, is_sharp boolean, is_adjusting boolean")
    return df.withColumn("box", F.when(F.col("x").isNotNull(), F.struct("x", "y", "w", "h"))).withColumn("score", F.col("seq") * 1.0)


def test_gate(spark):
    got = {}
    for r in gate.decisions(frames(spark, [a for a, _ in GATES])).orderBy("session_id", "seq").collect():
        got[r["session_id"]] = got.get(r["session_id"], "") + "FT"[r["should_capture"]]
    assert [got[k] for k in range(len(GATES))] == [b for _, b in GATES]


def test_best_frame_is_the_earliest_of_the_best(spark):
    rows = gate.decisions(frames(spark, ["RRRRR"]).withColumn("score", F.lit(1.0)))
    assert [tuple(r) for r in gate.best_frames(rows).collect()] == [(0, 2, 0, 1.0)]


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
THROTTLE = [(10.0, True), (10.25, True), (10.30, False), (10.51, True)]
REFOCUS = [(10.0, 0.5, "focused", True), (10.2, 0.7, "focused", False), (10.9, 0.7, "focused", True), (11.8, 0.71, "tooBlurry", False), (12.1, 0.71, "tooBlurry", True), (12.2, 0.1, "focused", False)]


def test_throttle(spark):
    df = spark.createDataFrame([("a", i, t) for i, (t, _) in enumerate(THROTTLE)], "k string, seq int, t double")
    assert [r["accepted"] for r in folds.throttle(df, ["k"], ["seq"]).orderBy("seq").collect()] == [ok for _, ok in THROTTLE]


def test_refocus(spark):
    df = spark.createDataFrame([("a", i, t, p, p, why) for i, (t, p, why, _) in enumerate(REFOCUS)], "k string, seq int, t double, px double, py double, reason string")
    assert [r["requested"] for r in folds.refocus(df, ["k"], ["seq"]).orderBy("seq").collect()] == [ok for *_, ok in REFOCUS]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, float(t), float(rng.random()), 0.5, "tooBlurry" if rng.random() < 0.4 else "focused") for k in range(5) for i, t in enumerate(np.cumsum(rng.random(60) * 0.5))]
    rows.sort(key=lambda r: r[1])
    schema = "k int, seq int, t double, px double, py double, reason string"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set(NO_DATA, "false")
    for op, batch, column in ((stateful.throttle, folds.throttle, "accepted"), (stateful.refocus, folds.refocus, "requested")):
        name = f"out_{column}"
        q = op(stream, ["k"]).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        key = lambda df: sorted((r["k"], r["seq"], r[column]) for r in df.collect())
        assert key(spark.table(name)) == key(batch(spark.createDataFrame(rows, schema), ["k"], ["seq"]))


def test_ordered_dedup_replaces_in_place(spark):
    rows = [(0, "falcon", 0.60, 0.1, 0.7, 0.4, 0.1), (1, "falcon", 0.90, 0.12, 0.71, 0.38, 0.09), (2, "falcon", 0.70, 0.1, 0.2, 0.4, 0.1)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, i int, text_key string, confidence double, x double, y double, w double, h double")
    got = folds.deduplicated(df, ["k"], ["i"]).orderBy("place").collect()
    assert [(r["confidence"], r["merged"]) for r in got] == [(0.90, 2), (0.70, 1)]


def test_reading_order(spark):
    items = [("bottom", 0.10, 0.10), ("right", 0.50, 0.80), ("left", 0.10, 0.80)]
    df = spark.createDataFrame([(json.dumps(items),)], "x string").select(F.array(*(F.struct(F.lit(n).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.2).alias("w"), F.lit(0.05).alias("h")) for n, x, y in items)).alias("items"))
    assert df.select(folds.combined_text(F.col("items")).alias("t")).first()["t"] == "left\nright\nbottom"


def test_grid_statistics(spark):
    df = spark.createDataFrame([([0.0] * 5 + [1.0, 2.0] + [0.0] * 5, 4, 3), ([1.0] * 4, 2, 2)], "v array<double>, w int, h int")
    got = df.select(grids.laplacian_variance(F.col("v"), F.col("w"), F.col("h")).alias("l"), grids.tenengrad(F.col("v"), F.col("w"), F.col("h")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(6.25, 3.0), (None, None)]


@pytest.mark.parametrize("seed", range(5))
def test_components_equal_search(seed):
    mask = np.random.default_rng(seed).random((9, 11)) < 0.5
    seen, want = set(), []
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        stack, cells = [(y, x)], []
        seen.add((y, x))
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < 9 and 0 <= d < 11 and mask[c, d] and (c, d) not in seen:
                    seen.add((c, d))
                    stack.append((c, d))
        ys, xs = zip(*cells)
        want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    assert grids.labelled(mask) == want


def spiral(n):
    mask = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    mask[0, 0] = True
    inside = lambda a, b: 0 <= a < n and 0 <= b < n
    while True:
        for _ in range(2):
            a, b = y + dy, x + dx
            if inside(a, b) and not mask[a, b] and not (inside(a + dy, b + dx) and mask[a + dy, b + dx]):
                break
            dy, dx = dx, -dy
        else:
            return mask
        y, x = a, b
        mask[y, x] = True


def test_components_of_a_spiral_and_of_odd_masks():
    mask = spiral(240)
    began = time.time()
    found = grids.labelled(mask)
    took = time.time() - began
    assert found == [(0, 0, 240, 240, int(mask.sum()))] and mask.sum() > 20_000 and took < 0.5
    assert grids.labelled(np.zeros((3, 4), bool)) == [] == grids.labelled(np.zeros((0, 0), bool))
    assert grids.labelled(np.ones((3, 4), bool)) == [(0, 0, 4, 3, 12)]
    combs = np.zeros((50, 99), bool)
    combs[:, ::2] = True
    assert len(grids.labelled(combs)) == 50
    combs[-1] = True
    assert grids.labelled(combs) == [(0, 0, 99, 50, int(combs.sum()))]


def test_dilation_is_a_square():
    mask = np.zeros((7, 7), bool)
    mask[3, 3] = True
    assert grids.dilated(mask, 2).sum() == 25 and grids.dilated(mask, 2)[1:6, 1:6].all()


def test_iou_of_disjoint_boxes(spark):
    assert spark.range(1).select(g.iou(g.rect(0, 0, 1, 1), g.rect(2, 2, 1, 1)).alias("v")).first()["v"] == 0


def test_gate_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    kinds = [*FRAMES] + ["R"] * 12
    sequences = ["".join(rng.choice(kinds, 30)) for _ in range(12)]
    rows = frames(spark, sequences).withColumn("score", F.round(F.rand(3), 2)).withColumn("error", F.when(F.col("seq") % 7 == 6, "crop failed"))
    rows.select("session_id", "seq", "box", "is_sharp", "is_adjusting", "score", "error").write.parquet(f"{tmp_path}/all")
    rows = spark.read.parquet(f"{tmp_path}/all")
    for part in range(3):
        rows.where((F.col("seq") >= part * 10) & (F.col("seq") < part * 10 + 10)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = stateful.frames(spark, f"{tmp_path}/in", rows.schema)
    q = stateful.gate(stream).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", f"{tmp_path}/gate").start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    good, bad = gate.split_errors(rows)
    batch = gate.decisions(good)
    flags = ("session_id", "seq", "should_capture", "is_stable", "is_eligible", "did_reset")
    got = spark.table("gated")
    assert sorted(tuple(r[c] for c in flags) for r in got.collect()) == sorted(tuple(r[c] for c in flags) for r in batch.collect())
    assert bad.count() > 0 and got.where("should_capture").count() > 3
    best = sorted((r["session_id"], r["seq"], r["best_seq"], r["best_score"]) for r in got.where("should_capture").collect())
    assert best == sorted(tuple(r) for r in gate.best_frames(batch).collect())


def test_merged_candidates_keep_the_better_side_first(spark):
    rows = [(0, "falcon", 0.6, 0.1, ["falcon", "Falcon"]), (1, "falcon", 0.9, 0.1, ["FALCON", "hawk"]), (2, "falcon", 0.7, 0.1, ["owl", "HAWK "]), (3, "falcon", 0.7, 0.9, ["owl", "owl"])]
    df = spark.createDataFrame([("a", i, k, c, x, 0.1, 0.2, 0.2, [(t,) for t in said]) for i, k, c, x, said in rows], "k string, i int, text_key string, confidence double, x double, y double, w double, h double, candidates array<struct<text: string>>")
    got = folds.deduplicated(df, ["k"], ["i"]).orderBy("place").collect()
    assert [(r["confidence"], r["merged"], [c["text"] for c in r["candidates"]]) for r in got] == [(0.9, 3, ["FALCON", "hawk", "owl"]), (0.7, 1, ["owl", "owl"])]


def test_place_follows_the_key_over_all_texts(spark):
    rows = [(0, "b"), (1, "a"), (2, "b"), (3, "c")]
    df = spark.createDataFrame([("k", i, t, 0.5, 0.1, 0.1, 0.2, 0.2) for i, t in rows], "k string, i int, text_key string, confidence double, x double, y double, w double, h double")
    assert [(r["text_key"], r["merged"]) for r in folds.deduplicated(df, ["k"], ["i"]).orderBy("place").collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_reading_order_of_boxes_without_one(spark):
    """Middles that drift by less than a line: as an insertion sort, and no error."""
    rng = random.Random(8)
    keys = [(k, [(f"{i}", rng.random(), rng.random() / (1 + k % 9), 0.1, rng.random() / 20) for i in range(rng.randrange(200 if k % 10 else 3))]) for k in range(400)]

    def before(a, b):
        p, q = a[2] + a[4] / 2, b[2] + b[4] / 2
        return p > q if abs(p - q) > 0.025 else a[1] < b[1]

    df = spark.createDataFrame(keys, "k long, items array<struct<text: string, x: double, y: double, w: double, h: double>>").repartition(8)
    got = {r["k"]: r["t"] for r in df.select("k", folds.combined_text(F.col("items")).alias("t")).collect()}
    for k, items in keys:
        done = []
        for item in items:
            at = len(done)
            while at and before(item, done[at - 1]):
                at -= 1
            done.insert(at, item)
        assert got[k] == "\n".join(x[0] for x in done)


def test_reading_order_of_ties_is_that_of_the_table(spark, tmp_path):
    """Files of other sizes are read in another order than their names'; prices apart by a hair; no price, no text."""
    nan, price = float("nan"), 63000.0
    near = np.nextafter(price, 1e9)
    first = [(1, 2, 5.0, "A"), (1, 5, 5.0, "R"), (2, 1, None, "A"), (2, 4, nan, "N"), (3, 3, near, "N"), (4, None, 1.0, "A"), (5000, None, 1.0, "A"), (5, 1, 1.0, "A"), (5, None, 2.0, "A"), (5, 3, 1.0, None), (5, 2, 1.0, "R")]
    second = [(1, 2, 5.0, "N"), (1, 5, 5.0, "A"), (2, 7, 3.0, "R"), (2, 2, None, "R"), (3, 6, price, "A"), *((k, n, 7.0, "ANR"[n % 3]) for k in range(10, 500) for n in (4, 1, 7, 2))]
    third = [(k, n, 7.0, "R") for k in range(1, 300) for n in (7, 5, 4)]
    os.mkdir(f"{tmp_path}/lineitem.parquet")
    for name, rows in (("part-2", second), ("part-1", first), ("part-10", third)):
        columns = dict(zip(("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"), (list(c) for c in zip(*rows))))
        pq.write_table(pa.table(columns, pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_extendedprice", pa.float64()), ("l_returnflag", pa.string())])), f"{tmp_path}/lineitem.parquet/{name}.parquet")
    got = {r["l_orderkey"]: (r["text"], r["n"]) for r in catalogue.queries()["reading_order"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("set threads = 1")  # with more, SQL leaves ties to chance
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == {k: (text, n) for k, text, n in con.execute("select l_orderkey, text, n from (" + catalogue.oracle_sql()["reading_order"] + ")").fetchall()}
    assert got[1] == ("A2\nR5\nN2\nA5\nR5\nR7\nR4", 7)


def _streamed(spark, tmp_path, rows, op, parts):
    """The rows of ``op`` on a stream of ``parts`` files, restarted after each."""
    for part in range(parts):
        rows.where(F.col("part") == part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = stateful.frames(spark, f"{tmp_path}/in", rows.schema)
        q = op(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_throttle_resets_in_batch_and_on_a_restarted_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set(NO_DATA, "false")
    rng = random.Random(9)
    rows = spark.createDataFrame([(k, i, i * 0.1 + rng.random() / 20, rng.random() < 0.2, i // 20) for k in range(5) for i in range(60)], "k int, seq int, t double, again boolean, part int")
    batch = folds.throttle(rows, ["k"], ["seq"], reset="again")
    got = _streamed(spark, tmp_path, rows, lambda s: stateful.throttle(s, ["k"], reset="again"), 3)
    key = lambda df: sorted((r["k"], r["seq"], r["accepted"]) if r["accepted"] is not None else (r["k"], r["seq"]) for r in df.collect())
    assert key(got) == key(batch) and got.where("again and accepted is not null").count() == 0
    plain = folds.throttle(rows, ["k"], ["seq"])
    assert batch.where("accepted").count() > plain.where("accepted and not again").count()


def test_late_frames_are_dropped_across_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set(NO_DATA, "false")
    rng = random.Random(10)
    rows = spark.createDataFrame([(k, i, i * 0.1, i * 0.1 + rng.random() * 0.5, i // 20) for k in range(6) for i in range(60)], "k int, seq int, arrived double, done double, part int")
    got = _streamed(spark, tmp_path, rows, lambda s: stateful.on_time(s, ["k"]), 3)
    key = lambda df: sorted((r["k"], r["seq"]) for r in df.collect())
    assert key(got) == key(gate.on_time(rows, "k")) and 0 < got.count() < 360


def test_state_of_silent_keys_ends(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set(NO_DATA, "false")
    rows = spark.createDataFrame([(k, i, float(i), part) for part, keys in ((0, range(20)), (1, [99]), (2, [99])) for k in keys for i in range(3)], "k int, seq int, t double, part int")

    def waiting(stream):
        time.sleep(2.5)
        return stateful.throttle(stream, ["k"], idle=2.0)

    got = _streamed(spark, tmp_path, rows, waiting, 3)
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/mark")
    assert {r["key"][0] for r in kept.collect()} <= {99}
    assert got.where("k = 99 and seq = 0 and accepted").count() == 2  # silent for longer than idle, so it begins anew


def test_frames_of_unknown_sharpness_are_not_remembered(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set(NO_DATA, "false")
    rows = [(s, i, *R, sharp, 1.0 + i, i // 2) for s, flags in enumerate([[None] * 4, [True, None, None], [True, True, None], [False, None, None, None], [None, True, True]]) for i, sharp in enumerate(flags)]
    df = spark.createDataFrame(rows, "session_id int, seq int, x double, y double, w double, h double, is_sharp boolean, score double, part int").withColumn("box", F.struct("x", "y", "w", "h")).withColumn("is_adjusting", F.lit(False))
    batch = sorted(tuple(r) for r in gate.best_frames(gate.decisions(df)).collect())
    got = _streamed(spark, tmp_path, df, stateful.gate, 2).where("should_capture")
    assert batch == sorted((r["session_id"], r["seq"], r["best_seq"], r["best_score"]) for r in got.where("best_seq is not null").collect())
    assert batch == [(1, 2, 0, 1.0), (2, 2, 1, 2.0), (4, 2, 2, 3.0)] and got.count() == 5
