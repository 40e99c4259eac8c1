"""Titles, scripts and candidates: expected values of the public fixtures."""

import pytest
from pyspark.sql import functions as F

from graupel.functions import geometry as g, scores as s, text as t

TITLES = [
    ("나비야e", "나비야ex"), ("나비야 e", "나비야ex"), ("나비야eX", "나비야ex"), ("サクラモチEX", "サクラモチex"), ("サクラモチ EX", "サクラモチex"),
    ("タケシ の オオグマ", "タケシのオオグマ"), ("サクラモチｅ", "サクラモチex"), ("ヤマネコ", "ヤマネコ"), ("N의 고양이", "N의 고양이"),
    ("Nのキツネビ EX", "Nのキツネビex"), ("山 猫 王", "山猫王"), ("Falcon VMAX", "Falcon VMAX"), ("  Falcon   GX\n", "Falcon GX"),
]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("given, expected", TITLES)
def test_title(spark, given, expected):
    assert one(spark, t.title(F.col("x")), given) == expected


@pytest.mark.parametrize("given, expected", [("サクラモチ", "ja"), ("나비야", "ko"), ("山猫王", "zh-Hans"), ("Falcon VMAX", "en"), ("V", None), ("12", None), ("の", "ja")])
def test_language(spark, given, expected):
    assert one(spark, t.language(F.col("x")), given) == expected


@pytest.mark.parametrize("given, expected", [("/species/12/", 12), ("https://h/x/7?page=2#top", 7)])
def test_id_in_url(spark, given, expected):
    assert one(spark, t.id_in_url(F.col("x")), given) == expected


def test_id_missing_in_url(spark):
    with pytest.raises(Exception, match="no id"):
        one(spark, t.id_in_url(F.col("x")), "/species/x/")


def test_graphemes_count_what_is_seen(spark):
    assert one(spark, t.graphemes(F.col("x")), "é") == 1


def test_suffix_needs_a_boundary(spark):
    assert one(spark, t.has_suffix(F.col("x")), "サクラモチex") and one(spark, t.has_suffix(F.col("x")), "Falcon V")
    assert not one(spark, t.has_suffix(F.col("x")), "FalconV")


def test_observation_key(spark):
    assert one(spark, t.observation_key(F.col("x")), " Ｆａｌｃ　on ﬁ ") == "falc on fi"


def test_best_title(spark):
    rows = [(0, "HP 70", 0.99, 0.78, 0.86, 0.12, 0.05), (1, "タケシのオオグマ", 0.78, 0.18, 0.86, 0.38, 0.05)]
    df = spark.createDataFrame(rows, "i int, x string, c double, a double, b double, w double, h double")
    score = s.title_score(F.col("x"), F.col("c"), F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "w", "h"), g.rect(0.12, 0.85, 0.63, 0.11))
    got = {r["i"]: r["score"] for r in df.select("i", score.alias("score")).collect()}
    assert got[0] is None and got[1] > 0


DETECTIONS = [
    ((0.22, 0.16, 0.36, 0.50), 0.72, True), ((0.20, 0.15, 0.43, 0.44), 0.68, True), ((0.10, 0.20, 0.55, 0.32), 0.90, False), ((0.30, 0.30, 0.08, 0.11), 0.90, False),
    ((0.20, 0.20, 0.34, 0.48), 0.40, False), ((0.01, 0.01, 0.96, 0.92), 0.90, False), ((0.10, 0.10, 0.70, 0.44), 0.90, False),
]


@pytest.mark.parametrize("box, confidence, accepted", DETECTIONS)
def test_detection(spark, box, confidence, accepted):
    d = spark.range(1).select(s.detection(g.rect(*box), F.lit(confidence)).alias("d")).first()["d"]
    assert (d["reasons"] == []) == accepted


def test_reasons_are_all_named(spark):
    d = spark.range(1).select(s.detection(g.rect(0.2, 0.2, 0.02, 0.02), F.lit(0.1)).alias("d")).first()["d"]
    assert {"lowConfidence", "poorScore"} <= set(d["reasons"])


def test_projections(spark):
    row = spark.range(1).select(
        g.from_region(g.rect(0.10, 0.20, 0.30, 0.40), g.rect(0, 0.5, 1, 0.5)).alias("a"), g.to_pixels(g.rect(0.2, 0.3, 0.4, 0.5), F.lit(1000.0), F.lit(800.0)).alias("b"),
        g.crop_projection(g.rect(5, 820, 260, 360), F.lit(600.0), F.lit(1000.0)).alias("c"),
    ).first()
    assert [round(v, 6) for v in row["a"]] == [0.10, 0.60, 0.30, 0.20]
    assert [round(v, 6) for v in row["b"]] == [200, 160, 400, 400]
    assert row["c"]["clipped"] and row["c"]["rect"]["x"] == 0 and round(row["c"]["rect"]["y"] + row["c"]["rect"]["h"], 6) == 1000
