"""From colour planes to boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graupel.operators import images

SCHEMA = "id long, red binary, green binary, blue binary, wide int, high int, box string, analysed int"


def card(width, height, x, y, w, h, table=(235, 232, 228), ink=(60, 90, 160)):
    planes = np.empty((3, height, width), np.uint8)
    planes[:] = np.array(table, np.uint8)[:, None, None]
    planes[:, y : y + h, x : x + w] = np.array(ink, np.uint8)[:, None, None]
    return [p.tobytes() for p in planes]


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, *(bytearray(p) if p is not None else None for p in planes), w, h, "clash", 1) for i, (planes, w, h) in enumerate(rows)], SCHEMA)
    return images.fallback_detections(df, ("red", "green", "blue"), "wide", "high", **options).orderBy("id").collect()


def test_cards_are_found_within_a_pixel(spark):
    cards = [(200, 250, 60, 50, 80, 112), (260, 200, 20, 30, 90, 126), (130, 130, 40, 10, 50, 70)]
    rows = found(spark, [(card(*c), c[0], c[1]) for c in cards], radius=0)
    for r, (width, height, x, y, w, h) in zip(rows, cards):
        got = (r["box"]["x"] * width, (1 - r["box"]["y"] - r["box"]["h"]) * height, r["box"]["w"] * width, r["box"]["h"] * height)
        assert got == pytest.approx((x, y, w, h), abs=1e-6) and r["reasons"] == [] and r["score"] > 0.55
    grown = found(spark, [(card(*c), c[0], c[1]) for c in cards])
    for r, (width, height, x, y, w, h) in zip(grown, cards):  # the mask grows by four pixels on each side
        assert (r["box"]["x"] * width, r["box"]["w"] * width) == pytest.approx((x - 4, w + 8), abs=1e-6)


def test_large_images_are_reduced(spark):
    (r,) = found(spark, [(card(1040, 1300, 200, 300, 400, 560), 1040, 1300)], radius=0)
    assert r["box"]["x"] * 1040 == pytest.approx(200, abs=5) and r["box"]["w"] * 1040 == pytest.approx(400, abs=10)
    assert (1 - r["box"]["y"] - r["box"]["h"]) * 1300 == pytest.approx(300, abs=5)


def test_the_larger_of_two_cards_of_one_shape(spark):
    planes = card(250, 200, 20, 20, 40, 56)
    other = card(250, 200, 120, 20, 90, 126)
    both = [bytes(np.minimum(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))) for a, b in zip(planes, other)]
    (r,) = found(spark, [(both, 250, 200)])
    assert r["box"]["x"] * 250 == pytest.approx(116, abs=1e-6)


def test_images_without_a_card(spark):
    blank = card(50, 60, 0, 0, 0, 0)
    rows = found(spark, [(blank, 50, 60), ([None] + blank[1:], 50, 60), (blank, 50, 61), (blank, None, 60), ([b""] * 3, 0, 0), (card(1, 1, 0, 0, 0, 0), 1, 1), (card(60, 50, 5, 20, 50, 8), 60, 50)])
    assert len(rows) == 7 and all(r["box"] is None and r["score"] is None and r["reasons"] is None for r in rows)


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = images.fallback_detections(df, ("red", "green", "blue"), "wide", "high")
    assert out.count() == 0 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_reduction_is_the_mean_of_what_is_covered():
    plane = np.random.default_rng(1).random((37, 23))
    small = images._sized(plane, 10, 7)
    for y in range(10):
        for x in range(7):
            part = plane[y * 37 // 10 : (y + 1) * 37 // 10, x * 23 // 7 : (x + 1) * 23 // 7]
            assert small[y, x] == pytest.approx(part.mean())


def test_detection_step_by_step_equals_the_expression(spark):
    from graupel.functions import scores as s

    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        x, y, w, h = rng.random(4) * (0.6, 0.6, 0.7, 0.7)
        at = lambda a, b: (float(a + rng.normal(0, 0.1)), float(b + rng.normal(0, 0.1)))
        corners = None if i % 9 == 0 else (at(x, y + h), at(x + w, y + h), at(x + w, y), at(x, y))
        rows.append((i, None if i % 50 == 7 else (float(x), float(y), float(w) if i % 11 else 0.0, float(h) if i % 13 else 0.0), float(rng.random() * 1.2), corners, 1))
    xy = "struct<x: double, y: double>"
    df = spark.createDataFrame(rows, f"id int, box struct<x: double, y: double, w: double, h: double>, c double, corners struct<tl: {xy}, tr: {xy}, br: {xy}, bl: {xy}>, __d_w int")
    got = s.with_detection(df, "d", "box", F.col("c"), "corners", F.lit(0.7531)).select("id", "d.*")
    want = df.select("id", s.is_convex(F.col("corners")).alias("convex"), s.shape_score(F.col("corners")).alias("shape"), s.detection(F.col("box"), F.col("c"), F.col("corners"), F.lit(0.7531)).alias("e"))
    seen = 0
    both = got.join(want.select("id", F.col("shape").alias("sh"), F.col("e.score").alias("b"), F.col("e.reasons").alias("rb")), "id")
    for r in both.withColumnsRenamed({"score": "a", "reasons": "ra"}).collect():
        assert r["a"] == (None if r["b"] is None else pytest.approx(r["b"], abs=1e-12)) and r["ra"] == r["rb"] and r["shape"] == r["sh"], r
        seen += bool(r["ra"])
    assert 50 < seen < 400
