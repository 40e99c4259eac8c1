"""The catalogue as a planned source and as a stream, over a server of our own."""

import contextlib
import io
import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from graupel.sources import catalogue_source as source, store

NOW = datetime(2024, 5, 1)


def resource(kind, name):
    return {"name": name, "url": f"https://feed.test/{kind}/{name}/"}


class Server(ThreadingHTTPServer):
    """``total`` records; counts what is asked for; ``bad`` details fail."""

    def __init__(self, total, listed=None):
        super().__init__(("127.0.0.1", 0), Answer)
        self.total, self.listed, self.pages, self.details, self.bad = total, listed, [], [], set()
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def base(self):
        return f"http://127.0.0.1:{self.server_port}/species"


class Answer(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        s = self.server
        if "?" in self.path:
            offset, size = (int(x.split("=")[1]) for x in self.path.split("?")[1].split("&"))
            s.pages.append(offset)
            ids = s.listed or [*range(1, s.total + 1)]
            body = {"count": s.total, "next": None, "previous": None, "results": [{"name": f" s-{i}", "url": f"{s.base}/{i}/"} for i in ids[offset : offset + size]]}
        else:
            i = int(self.path.rstrip("/").rpartition("/")[2])
            s.details.append(i)
            if i in s.bad:
                return self.send_error(500)
            body = {
                "id": i, "name": f"s-{i}", "evolution_chain": {"url": "https://feed.test/chain/1/"}, "color": resource("color", "red"), "evolves_from_species": None, "generation": resource("generation", "g"),
                "habitat": None, "is_baby": False, "is_legendary": False, "is_mythical": False, "names": [{"name": f"S{i}", "language": resource("language", "en")}], "genera": [],
                "index_numbers": [{"entry_number": i, "index": resource("index", "national")}],
            }
        said = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(said)


@pytest.fixture
def served(spark):
    source.register(spark)
    opened = []

    def start(*args, **kwargs):
        opened.append(Server(*args, **kwargs))
        return opened[-1]

    yield start
    for s in opened:
        s.shutdown()
        s.server_close()


def load(spark, s, **options):
    return spark.read.format("catalogue").option("base", s.base).options(**options).load()


def test_a_full_read_asks_for_each_page_and_record_once(spark, served):
    s = served(45)
    rows = source.records(load(spark, s)).collect()
    assert sorted(r["id"] for r in rows) == [*range(1, 46)] and rows[0]["names"][0]["language_name"] == "en"
    assert sorted(s.pages) == [0, 20, 40] and sorted(s.details) == [*range(1, 46)]  # 48 requests


@pytest.mark.parametrize("where, ids, pages", [
    ("id > 20 and id <= 30", range(21, 31), [0, 20]), ("id = 44", [44], [0, 40]), ("id < 3", [1, 2], [0]), ("id > 45", [], [0]), ("id > 5 and id < 5", [], []), ("id in (7, 9)", [7, 9], [0]),
])
def test_ranges_are_pushed_down(spark, served, where, ids, pages):
    s = served(45)
    df = load(spark, s).where(where)
    assert sorted(r["id"] for r in df.select("id").collect()) == [*ids]
    assert sorted(s.pages) == pages and len(s.details) <= max(len([*ids]), 3)


def test_pushed_range_shows_in_the_plan(spark, served):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        load(spark, served(45)).where("id > 20").explain("formatted")
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,20)]" in said.getvalue() and "* Filter" not in said.getvalue()


def test_limit_ends_the_listing(spark, served):
    s = served(200)
    assert load(spark, s, limit=25).count() == 40 and sorted(s.pages) == [0, 20]


def test_doubles_and_entries_beyond_the_count(spark, served):
    s = served(22, listed=[*range(1, 21), 21, 21, 23, 22])
    s.total = 22
    rows = source.records(load(spark, s)).collect()
    assert sorted(r["id"] for r in rows) == [*range(1, 23)]  # 23 is beyond the count


def test_failures_are_errors(spark, served):
    s = served(3)
    s.bad.add(2)
    with pytest.raises(Exception, match="Failed to fetch .*/2/: 500"):
        load(spark, s).collect()


def test_stream_goes_on_where_it_was_cut_off(spark, served, tmp_path):
    s, shop = served(25), store.Store(spark, str(tmp_path / "store"))
    marks = str(tmp_path / "marks")
    s.bad.add(24)
    with pytest.raises(Exception, match="500"):
        source.follow(spark, s.base, shop, marks, NOW)
    assert shop.table("species").count() == 0
    s.bad.clear()
    assert source.follow(spark, s.base, shop, marks, NOW) == 25
    asked = len(s.details)
    assert source.follow(spark, s.base, shop, marks, NOW) == 0 and len(s.details) == asked
    s.total = 47
    assert source.follow(spark, s.base, shop, marks, NOW) == 22
    assert sorted(s.details[asked:]) == [*range(26, 48)]
    for name in ("species", "names", "index_numbers"):
        assert shop.table(name).count() == 47
