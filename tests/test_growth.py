"""What a step costs by its plan, and that a cheaper way gives the same rows."""

import random

from pyspark.sql import functions as F

from graupel.functions import rules as r, text as t
from graupel.operators import folds
from graupel.plans import catalogue

TITLES = [
    None, "", "a", "Pika", "Pikachu", "PIKACHU", "Pikachu EX", "PiKAchu ", " pikachu", "x" * 21, "Mr Mime's-x", "brrr", "Piká́́́chu" + "ú" * 13, "ピカチュウex", "ピカチュウ", "이브이 VMAX", "이브이VMAX",
    "N의 조로아", "索罗亚GX", "皮卡丘", "的 V", "Chari 12", "VMAX", "ex", " ex", "abc\n", "abcd\n", "Pika\u0000", "ＡＢＣＤe", "cafés", "café", "👩‍👩‍👧‍👧ab", "A E", "A EX", "AEIÓ́",
]


def test_satisfied_is_not_another_pass(spark):
    rows = spark.createDataFrame([(x, d) for x in TITLES for d in ("en", "ja", "ko", "zh-Hans", None)], "x string, d string")
    got = rows.select("x", "d", t.satisfies(F.col("x"), F.col("d")).alias("a"), t.needs_another_pass(F.col("x"), F.col("d")).alias("b")).collect()
    assert all(r["a"] == (not r["b"]) for r in got)
    assert sum(r["a"] for r in got) > 8


def test_passes_shuffle_no_titles(spark, sf):
    plan = catalogue.queries()["supplemental_passes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]  # the window and its sort
    assert "RLIKE" not in above and "Window" in above


def test_reading_order_is_that_of_insertions():
    """By a sort where lines are apart, else by insertions; 30,000 boxes in lines take no square of steps."""
    rng, nan = random.Random(5), float("nan")
    for k in range(3000):
        odd = [None, nan, float("inf")] if k % 3 == 0 else []
        number = lambda n: rng.choice([*odd, *(i / n for i in range(n))])
        places = [(number(rng.choice((3, 60))), number(4)) for _ in range(rng.randrange(12))]
        want = []
        for i, place in enumerate(places):
            at = len(want)
            while at and folds.before(place, places[want[at - 1]]):
                at -= 1
            want.insert(at, i)
        assert folds.reading_order(places) == want
    many = [(i % 100 / 10, float(i)) for i in range(30000, 0, -1)]
    assert folds.reading_order(many) == sorted(range(30000), key=lambda i: (-many[i][0], many[i][1]))


def test_reading_order_of_odd_items(spark):
    """Nulls are before nothing, NaN is the largest number."""
    kind = "k int, items array<struct<text: string, x: double, y: double, w: double, h: double>>"
    at = lambda t, x, y: (t, x, y, 0.1, 0.0)
    rows = [(0, None), (1, []), (2, [None, at("a", None, 0.5), at(None, 0.1, 0.9), at("b", 0.2, 0.5), at("c", 0.1, None)]), (3, [at("a", 0.1, 0.5), at("b", 0.1, float("nan")), at("c", float("nan"), 0.5), at("d", 0.0, 0.5)])]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, kind).select("k", folds.combined_text(F.col("items")).alias("t")).collect()}
    assert got == {0: None, 1: "", 2: "a\nb\nc", 3: "b\nd\na\nc"}


def test_json_fields_are_taken_out_at_once(spark):
    """One look-up for each object, array or scalar of a rule; issues as before."""
    thing = r.Record(name=r.Text(), url=r.Text(url=True))
    rule = r.Record(id=r.Whole(1), on=r.Flag(), of=r.Nullable(thing), all=r.Each(thing))
    bodies = ['{"id":1.5,"on":0,"of":[],"all":[1,null,{},{"name":"\\u0085 ","url":" https://a.b \\u2003"}]}', '{"id":1e3,"on":true,"of":null,"all":[]}', "null", "7", "{bad", None]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select(r.listed(r.violations(F.col("b"), rule)).alias("v"))
    first = "id: type; on: type; of: type; all.0: type; all.1: null; all.2.name: missing; all.2.url: missing; all.3.name: blank"
    assert [x["v"] for x in df.collect()] == [first, "", "<root>: null", "<root>: type", "<root>: json", "<root>: json"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("variant_get(") <= 11
