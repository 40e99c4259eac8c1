"""Incremental loading of a paged catalogue, with a fetch of our own."""

import json
import os
import re
import sys
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from graupel.functions import rules
from graupel.sources import catalogue_feed as feed, lexicon, logs, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests

BASE = "https://feed.test/species"
NOW = datetime(2024, 5, 1)


def resource(kind, name):
    return {"name": name, "url": f"https://feed.test/{kind}/{name}/"}


def detail(i):
    return {
        "id": i, "name": f"s-{i}", "evolution_chain": {"url": "https://feed.test/chain/1/"}, "color": resource("color", "red"), "evolves_from_species": None if i == 1 else resource("species", f"s-{i - 1}"),
        "generation": resource("generation", "g-1"), "habitat": None if i % 2 == 0 else resource("habitat", "grassland"), "is_baby": False, "is_legendary": False, "is_mythical": False,
        "names": [{"name": f"S{i}", "language": resource("language", "en")}], "genera": [{"genus": "Seed", "language": resource("language", "en")}],
        "index_numbers": [{"entry_number": i, "index": resource("index", "national")}],
    }


class Feed:
    """Counts the pages asked for, on the driver or in tasks, by files."""

    def __init__(self, total, listed=None, bad=None, blank=None):
        self.total, self.listed, self.bad, self.blank = total, listed or [*range(1, total + 1)], bad, blank
        self.asked = tempfile.mkdtemp(prefix="feed-")

    @property
    def pages(self):
        return len(os.listdir(self.asked))

    def __call__(self, url):
        if "?" in url:
            os.close(tempfile.mkstemp(dir=self.asked)[0])
            offset = int(url.split("offset=")[1].split("&")[0])
            rows = self.listed[offset : offset + feed.PAGE_SIZE]
            following = feed.listing_url(BASE, offset + feed.PAGE_SIZE) if offset + feed.PAGE_SIZE < len(self.listed) else None
            return 200, json.dumps({"count": self.total, "next": following, "previous": None, "results": [{"name": f"s-{i}", "url": f"{BASE}/{i}/"} for i in rows]})
        i = int(url.rstrip("/").split("/")[-1])
        if i == self.bad:
            return 500, ""
        return 200, json.dumps(detail(i) | ({"name": ""} if i == self.blank else {}))


@pytest.fixture
def shop(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.prepare()
    return s


def test_full_load_then_cooldown(spark, shop):
    f = Feed(45)
    assert store.sync(shop, BASE, f, NOW) == 45 and f.pages == 3
    assert shop.table("names").count() == 45 and shop.table("species").where("habitat_name is null").count() == 22
    f = Feed(45)
    assert store.sync(shop, BASE, f, NOW) == 0 and f.pages == 1
    assert store.sync(shop, BASE, Feed(45), NOW + timedelta(days=1, milliseconds=1)) == 0
    assert shop.last_sync("species") == NOW + timedelta(days=1, milliseconds=1)


def test_resume_keeps_what_is_there(spark, shop):
    bodies = spark.createDataFrame([(i, json.dumps(detail(i))) for i in [*range(1, 19), 25]], "id long, body string")
    assert shop.insert(feed.normalised(bodies), NOW) == 19
    assert shop.insert(feed.normalised(bodies), NOW) == 0
    assert store.sync(shop, BASE, Feed(45), NOW) == 26
    assert shop.table("species").count() == 45


def test_failed_detail_marks_nothing(spark, shop):
    with pytest.raises(Exception, match="500"):
        store.sync(shop, BASE, Feed(5, bad=3), NOW)
    assert shop.last_sync("species") is None and shop.table("species").count() == 0


def test_empty_name_is_an_error(spark, shop):
    with pytest.raises(Exception, match="name"):
        store.sync(shop, BASE, Feed(3, blank=2), NOW)
    assert shop.table("species").count() == 0


def test_incomplete_listing_isnt_a_success(spark, shop):
    assert store.sync(shop, BASE, Feed(3, listed=[1, 2]), NOW) == 2
    assert shop.last_sync("species") is None


def test_first_of_each_listed_id(spark):
    body = json.dumps({"count": 22, "next": None, "previous": None, "results": [{"name": f"n{k}", "url": f"{BASE}/{i}/"} for k, i in enumerate([20, 21, 21, 23, 22])]})
    assert [tuple(r) for r in feed.new_summaries(feed.from_bodies(spark, [body]), 20, 22).collect()] == [(21, "n1"), (22, "n4")]


def test_guards(spark, shop, tmp_path):
    with pytest.raises(ValueError):
        store.Store(spark, "https://x/y")
    with pytest.raises(ValueError):
        shop.reset("/elsewhere")
    shop.clear()
    shop.reset(str(tmp_path))
    assert shop.exists("species") and shop.table("species").count() == 0


def test_lexicon_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("en", " Oakling"), ("en", "Oakling"), ("ja", "カシノキ"), ("xx", "no"), ("en", "  ")], "language_name string, name string")
    words = lexicon.words(rows, "language_name", "name")
    assert [tuple(r) for r in words.collect()] == [("en", "Oakling"), ("en", "Oakling"), ("ja", "カシノキ")]
    lexicon.write(words, f"{tmp_path}/words")
    back = lexicon.read(spark, f"{tmp_path}/words")
    assert sorted((r["language"], r["word"]) for r in back.collect()) == [("en", "Oakling"), ("en", "Oakling"), ("ja", "カシノキ")]
    assert [r["word"] for r in lexicon.distinct_words(back).collect()] == ["Oakling", "カシノキ"]


def test_log_contexts(spark):
    given = {"string": "value", "number": 1, "boolean": False, "empty": None, "array": ["value", 1, True, None, {"n": 1}], "object": {"n": 1}, "objectArray": [{"n": 1}]}
    got = spark.createDataFrame([(json.dumps(given),), ("no json",), (None,)], "x string").select(logs.sanitised("x").alias("y")).collect()
    assert json.loads(got[0]["y"]) == {"string": "value", "number": 1, "boolean": False, "empty": None, "array": ["value", 1, True, None]}
    assert got[1]["y"] is None and got[2]["y"] is None


def test_cut_off_run_doubles_nothing(spark, shop):
    bodies = spark.createDataFrame([(i, json.dumps(detail(i))) for i in range(1, 6)], "id long, body string")
    records = feed.normalised(bodies)
    feed.children(records, "names").write.mode("append").parquet(shop.path("names"))  # and then it died
    assert shop.insert(records, NOW) == 5
    assert shop.table("names").count() == 5 and shop.table("genera").count() == 5
    joined = feed.with_children(shop.table("species"), shop.table("names").withColumnRenamed("name", "said"))
    assert joined.where("said = concat('S', id)").count() == 5


def test_overwrite_cut_off_between_renamings(spark, shop):
    shop.mark("species", NOW)
    fs, p = shop._hadoop(shop.path("sync_state"))
    fs.rename(p, shop._hadoop(f"{shop.root}/_old_sync_state")[1])
    assert shop.last_sync("species") == NOW


@pytest.mark.parametrize("blank", ["", " ", "\t\n", "\u00a0"])
def test_blank_names_are_errors(spark, blank):
    body = spark.createDataFrame([(1, json.dumps(detail(1) | {"name": blank}))], "id long, body string")
    with pytest.raises(Exception, match="name"):
        feed.normalised(body).collect()


BAD = [
    ({"names": [{"name": " ", "language": resource("language", "en")}]}, "names.0.name: blank"),
    ({"index_numbers": [{"entry_number": -1, "index": resource("index", "x")}]}, "index_numbers.0.entry_number: range"),
    ({"is_baby": None}, "is_baby: null"),
    ({"color": {"name": "red", "url": "nowhere"}}, "color.url: url"),
    ({"habitat": {"name": "\u3000", "url": "https://x.test/"}}, "habitat.name: blank"),
    ({"genera": [{"genus": "a", "language": resource("l", "en")}, {"genus": "a", "language": None}]}, "genera.1.language: null"),
    ({"names": None}, "names: null"),
    ({"id": 0}, "id: range"), ({"id": 1.5}, "id: type"), ({"id": "1"}, "id: type"), ({"is_mythical": 1}, "is_mythical: type"), ({"names": {}}, "names: type"),
    ({"generation": "g", "name": 7}, "name: type; generation: type"), ({"evolution_chain": {"url": "https://"}}, "evolution_chain.url: url"), ({"names": [None, 3]}, "names.0: null; names.1: type"),
]


@pytest.mark.parametrize("change, said", BAD)
def test_bad_details_name_their_issues(spark, change, said):
    body = spark.createDataFrame([(json.dumps(detail(1) | change),)], "body string")
    assert body.select(rules.listed(rules.violations(F.col("body"), feed.detail_rule())).alias("x")).first()["x"] == said
    with pytest.raises(Exception, match=re.escape(said)):
        feed.normalised(body).select("id").collect()


def test_good_details_have_no_issues(spark):
    kept = {**detail(1), "more": {"x": [1]}, "id": 3.0, "habitat": None, "names": [], "color": {"name": " red ", "url": "HTTPS://u:p@x.test:80/a?b#c", "other": 1}}
    bodies = spark.createDataFrame([(json.dumps(kept),), (json.dumps(detail(2) | {"evolution_chain": {"url": "urn:x:1"}}),)], "body string")
    rows = feed.normalised(bodies).orderBy("id").collect()
    assert [r["id"] for r in rows] == [2, 3] and rows[1]["color_name"] == "red" and rows[1]["habitat_name"] is None and rows[1]["names"] == []
    lacking = {k: v for k, v in detail(1).items() if k not in ("is_baby", "habitat")}
    texts = spark.createDataFrame([(json.dumps(lacking),), ("{",), (None,), ("[]",), ("null",)], "body string")
    assert [r["x"] for r in texts.select(rules.listed(rules.violations(F.col("body"), feed.detail_rule())).alias("x")).collect()] == ["habitat: missing; is_baby: missing", "<root>: json", "<root>: json", "<root>: type", "<root>: null"]


@pytest.mark.parametrize("change", [{"count": -1}, {"next": "x"}, {"results": None}, {"results": [{"name": "", "url": f"{BASE}/1/"}]}, {"previous": 3}])
def test_bad_pages_are_errors(spark, change):
    body = json.dumps({"count": 1, "next": None, "previous": None, "results": [{"name": "a", "url": f"{BASE}/1/"}]} | change)
    with pytest.raises(Exception, match="bad page"):
        feed.summaries(feed.from_bodies(spark, [body])).collect()


def test_listing_goes_on_behind_the_announced_count(spark, shop):
    f = Feed(45, listed=[*range(1, 21)] * 2 + [*range(21, 46)])
    assert store.sync(shop, BASE, f, NOW) == 45 and f.pages == 4
    assert shop.last_sync("species") == NOW


def test_answer_row_and_mode(spark, tmp_path):
    from graupel import __main__ as command
    from graupel.operators import passes

    cloudpickle.register_pickle_by_value(command)
    got = command.synchronise(spark, str(tmp_path / "s"), BASE, Feed(3), NOW, "seed")
    assert [r.asDict() for r in got.collect()] == [{"saved": 3}]
    with pytest.raises(LookupError):
        command.synchronise(spark, str(tmp_path / "s"), BASE, Feed(3), NOW, None)
    with pytest.raises(Exception, match="not a mode"):
        spark.range(1).select(passes.mode(F.lit("x"))).collect()
    assert passes.gated(spark.range(2), "TEST", "SEED").count() == 2


def test_records_and_issues(spark):
    record = {"token": "t", "req": {"headers": {"authorization": "a", "x": 1}}, "tokens": "kept", "body": {"a": 1}}
    context = {"validations": [{}, None, {"path": None}, {"path": []}, {"path": ["name", 0]}, {"path": [None]}, {"path": "x"}]}
    row = spark.createDataFrame([(json.dumps(record), json.dumps(context))], "a string, b string").select(logs.redacted_record("a").alias("a"), logs.issue_paths("b").alias("b")).first()
    mark = "[Redacted]"
    assert json.loads(row["a"]) == {"token": mark, "req": {"headers": {"authorization": mark, "x": 1}}, "tokens": "kept", "body": mark}
    assert row["b"] == ["<root>", "<root>", "<root>", "name.0"]
    try:
        raise ValueError("outer") from KeyError("inner")
    except ValueError as e:
        said = logs.error_record(e)
    assert (said["error_name"], said["error_message"], said["error_cause_name"]) == ("ValueError", "outer", "KeyError") and "Traceback" in said["error_stack"]
    assert logs.error_record("x") == {"error_name": "str", "error_details": "x"} and logs.error_record([1])["error_details"] == "Non-Error value thrown" and logs.error_record(None) is None


def test_iso_time(spark):
    assert spark.sql("select timestamp'2024-05-01 10:20:30.123' as t").select(store.iso(F.col("t")).alias("x")).first()["x"] == "2024-05-01T10:20:30.123Z"


def test_first_error_of_passes_without_observations(spark):
    from graupel.operators import passes

    rows = spark.createDataFrame([(1, 1, "late", 0), (1, 0, "early", None), (2, 0, "lost", 0), (2, 1, None, 2), (3, 0, None, 0)], "k int, place int, error string, observations int")
    assert sorted(tuple(r) for r in passes.outcomes(rows, "k", "place").collect()) == [(1, 0, "early"), (2, 2, None), (3, 0, None)]
    with pytest.raises(Exception, match="early"):
        passes.outcomes(rows, "k", "place", raising=True).collect()
    assert passes.outcomes(rows.where("k > 1"), "k", "place", raising=True).count() == 2
