"""The registered queries of the library's own operators, with their SQL.

The driver's tables stand in for the operators' own inputs: frames, boxes and
titles are derived from them by plain arithmetic, the same way in the query and
in its SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as g, rules as r, scores as s, text as t
from ..operators import folds, gate, grids, keys, passes
from ..session import shared_dir
from ..sources import lexicon, log_sink, logs, store
from ..sources.records import Records

FLAGSHIP = "lexicon_groups"


def _table(spark: SparkSession, sf_dir: str, name: str, *expressions: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.selectExpr(*expressions) if expressions else df


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


# ---- keys, joins, aggregates ---------------------------------------------------


@query("SELECT lang AS language, trim(source) AS word FROM documents WHERE lang IN ('de','en','es','fr') AND trim(source) <> '' GROUP BY lang, source")
def lexicon_groups(spark, sf):
    return lexicon.words(_table(spark, sf, "documents"), "lang", "source", ("de", "en", "es", "fr"))


_PAGE_IDS = r"SELECT page_id, CAST(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/(\d+)/?$', 1) AS BIGINT) AS id FROM pages WHERE regexp_matches(regexp_replace(url, '[?#].*$', ''), '/(\d+)/?$')"


@query(f"""
WITH p AS ({_PAGE_IDS}), d AS (SELECT DISTINCT id FROM p WHERE id >= 1), r AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM d),
b AS (SELECT count(*) FILTER (WHERE id = n) AS prefix, max(id) AS total FROM r)
SELECT id, min(page_id) AS page_id FROM p, b WHERE id > prefix AND id <= total GROUP BY id
""")
def first_page_dedup(spark, sf):
    pages = _table(spark, sf, "pages").where(F.rlike(F.regexp_replace("url", r"[?#].*$", ""), F.lit(r"/(\d+)/?$")))
    rows = pages.select(t.id_in_url(F.col("url")).alias("id"), "page_id")
    prefix, total = keys.contiguous_prefix(rows, "id").first()["prefix"] or 0, rows.agg(F.max("id").alias("n")).first()["n"] or 0
    return keys.first_of_each(rows.where((F.col("id") > prefix) & (F.col("id") <= total)), ["id"], [F.asc("page_id")]).orderBy("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, sf):
    return keys.missing(_table(spark, sf, "orders", "o_orderkey"), _table(spark, sf, "lineitem", "l_orderkey as o_orderkey"), "o_orderkey")


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def present_keys(spark, sf):
    there = keys.present(_table(spark, sf, "orders"), _table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey as o_orderkey"), "o_orderkey")
    return there.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("""
WITH ids AS (SELECT DISTINCT o_orderkey + 1 AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
r AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM ids WHERE id >= 1)
SELECT count(*) AS prefix FROM r WHERE id = n
""")
def contiguous_prefix(spark, sf):
    have = keys.present(_table(spark, sf, "orders", "o_orderkey"), _table(spark, sf, "lineitem", "l_orderkey as o_orderkey"), "o_orderkey")
    return keys.contiguous_prefix(have.select((F.col("o_orderkey") + 1).alias("id")), "id").select(F.col("prefix").cast("long").alias("prefix"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def best_item_per_order(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return keys.best_of_each(rows, ["l_orderkey"], "l_extendedprice", F.asc("l_linenumber"))


@query("SELECT event_id, epoch_ms(TIMESTAMP '2024-01-15 00:00:00') - epoch_ms(ts) < 7 * 86400000 AS cooling FROM events")
def cooldown_flag(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return _table(spark, sf, "events").select("event_id", store.cooling(F.col("ts").cast("timestamp"), now, 7).alias("cooling"))


@query("SELECT conv_id, turn, upper(role) AS role, length(text) AS chars FROM conversations")
def nested_explode(spark, sf):
    nested = _table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    mapped = nested.select("conv_id", F.transform("turns", lambda x: F.struct(x["turn"].alias("turn"), F.upper(x["role"]).alias("role"), F.length(x["text"]).cast("long").alias("chars"))).alias("turns"))
    return mapped.select("conv_id", F.inline("turns"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return _table(spark, sf, "events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem),
s AS (SELECT l_orderkey, i, concat_ws('; ', CASE WHEN l_partkey % 23 = 0 THEN 'lines.' || i || '.quantity: range' END,
  CASE WHEN l_linenumber = 6 AND l_orderkey % 3 = 0 THEN 'lines.' || i || '.part: null' WHEN l_suppkey % 29 = 0 THEN 'lines.' || i || '.part.url: url' END) AS said FROM l),
a AS (SELECT l_orderkey, string_agg(said, '; ' ORDER BY i) FILTER (WHERE said <> '') AS said FROM s GROUP BY l_orderkey)
SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 13 = 0 THEN 'id: range' END, CASE WHEN o_orderkey % 11 = 0 THEN 'name: blank' END, CASE WHEN o_orderkey % 17 = 0 THEN 'link: url' END,
  CASE WHEN o_orderkey % 38 = 0 THEN 'urgent: missing' WHEN o_orderkey % 19 = 0 THEN 'urgent: null' END, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'customer.name: type' END, said) AS issues
FROM orders JOIN a ON l_orderkey = o_orderkey
""")
def json_violations(spark, sf):
    """Orders with their lines as nested JSON, some of it bad: all issues of each."""
    part = "if(l_linenumber = 6 and l_orderkey % 3 = 0, null, struct(concat('p', l_partkey) as name, if(l_suppkey % 29 = 0, 'p', concat('https://shop.test/part/', l_partkey)) as url))"
    lines = _table(spark, sf, "lineitem", "l_orderkey", f"struct(l_linenumber, l_partkey, l_suppkey, l_quantity, if(l_partkey % 23 = 0, -1, cast(l_quantity as long)) as quantity, {part} as part) as line")
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    k = F.col("o_orderkey")
    customer = F.when(k % 5 != 0, F.struct(F.col("o_custkey").cast("string").alias("name"), F.concat(F.lit("https://shop.test/customer/"), "o_custkey").alias("url")))
    row = F.struct(
        F.when(k % 13 == 0, -k).otherwise(k).alias("id"), F.when(k % 11 == 0, " \u00a0").otherwise(F.col("o_orderstatus")).alias("name"), F.when(k % 17 == 0, "nowhere").otherwise(F.concat(F.lit("https://shop.test/order/"), k)).alias("link"),
        F.when(k % 19 != 0, F.col("o_orderstatus") == "O").alias("urgent"), customer.alias("customer"), "lines",
    )
    body = F.to_json(row, {"ignoreNullFields": "false"})
    body = F.when(k % 38 == 0, F.replace(body, F.lit('"urgent":null,'), F.lit(""))).otherwise(body)
    body = F.when(k % 7 == 0, F.regexp_replace(body, r'"customer":\{"name":"(\d+)"', r'"customer":{"name":$1')).otherwise(body)
    thing = r.Record(name=r.Text(), url=r.Text(url=True))
    rule = r.Record(id=r.Whole(1), name=r.Text(), link=r.Text(url=True), urgent=r.Flag(), customer=r.Nullable(thing), lines=r.Each(r.Record(quantity=r.Whole(0), part=thing)))
    bodies = _table(spark, sf, "orders").join(lines, k == F.col("l_orderkey")).select(k, body.alias("body"))
    return bodies.select("o_orderkey", r.listed(r.violations(F.col("body"), rule)).alias("issues"))


@query("""
WITH o AS (SELECT user_id, max(ts) AS last FROM events WHERE ts < TIMESTAMP '2024-01-28 00:00:00' GROUP BY user_id),
n AS (SELECT user_id, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY user_id)
SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n
""")
def state_upsert(spark, sf):
    """The state of the users up to a day, and what came later on top."""
    events = _table(spark, sf, "events")
    day = F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    last = lambda rows: rows.groupBy("user_id").agg(F.max("ts").alias("last"))
    return store.upserted(last(events.where(F.col("ts") < day)), last(events.where(F.col("ts") >= day)), "user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def insert_if_absent(spark, sf):
    return keys.missing(_table(spark, sf, "customer", "c_custkey", "c_name").dropDuplicates(["c_custkey"]), _table(spark, sf, "orders", "o_custkey as c_custkey"), "c_custkey")


@query("""
SELECT c_custkey, c_custkey % 3 <> 0 AS fresh, count(o_orderkey) FILTER (WHERE c_custkey % 3 <> 0) AS children, sum(o_orderkey) FILTER (WHERE c_custkey % 3 <> 0) AS child_keys
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def insert_records(spark, sf):
    """Customers with their orders onto a table that has a third of them: what
    is there stays, the others come with their children."""
    orders = _table(spark, sf, "orders", "o_custkey as c_custkey", "o_orderkey").groupBy("c_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    records = _table(spark, sf, "customer", "c_custkey", "c_name").join(orders, "c_custkey", "left")
    stored = records.where("c_custkey % 3 = 0").select("c_custkey")
    new = keys.missing(records, stored, "c_custkey")
    children = new.select("c_custkey", F.explode("keys").alias("k")).groupBy("c_custkey").agg(F.count("k").alias("children"), F.sum("k").alias("child_keys"))
    parents = stored.withColumn("fresh", F.lit(False)).unionByName(new.select("c_custkey").withColumn("fresh", F.lit(True)))
    return parents.join(children, "c_custkey", "left").select("c_custkey", "fresh", F.coalesce("children", F.lit(0).cast("long")).alias("children"), "child_keys")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS run, count(*) OVER (PARTITION BY o_orderstatus = 'F') AS saved, coalesce(lines, 0) AS lines, quantity
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def nested_records(spark, sf):
    """Orders with their lines, written as nested rows in two runs: the filled
    ones, then all, of which the first stay; read back by the views."""
    lines = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    orders = _table(spark, sf, "orders", "o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kept = Records(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}", "o_orderkey long, run int, lines array<struct<l_linenumber: int, l_quantity: double>>", "o_orderkey")
    saved = [kept.insert(rows.withColumn("run", F.lit(run))) for run, rows in ((1, orders.where("o_orderstatus = 'F'")), (2, orders))]
    sums = kept.children("lines", "k").groupBy("k").agg(F.count("l_linenumber").alias("lines"), F.sum("l_quantity").alias("quantity"))
    n = F.when(F.col("run") == 1, saved[0]).otherwise(saved[1]).cast("long")
    return kept.rows("o_orderkey", "run").join(sums, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", "run", n.alias("saved"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), "quantity")


@query("""
WITH r AS (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1)
SELECT d.doc_id, r.first_id FROM documents d LEFT JOIN r ON sha256(d.text) = r.h
""")
def hash_lookup(spark, sf):
    docs = _table(spark, sf, "documents", "doc_id", "sha2(text, 256) as h")
    known = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(known, "h", "left").select("doc_id", "first_id")


@query("""
WITH l AS (SELECT lang AS language, source AS word, min(doc_id) AS line FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY language, line) AS n FROM l)
SELECT language, line AS ordinal, word FROM r WHERE n = 1
""")
def word_union(spark, sf):
    rows = _table(spark, sf, "documents").groupBy(F.col("lang").alias("language"), F.col("source").alias("word")).agg(F.min("doc_id").alias("line"))
    return lexicon.distinct_words(rows, ["en", "fr"])


@query("""
WITH l AS (SELECT lang AS language, source AS word, min(doc_id) AS line FROM documents GROUP BY 1, 2)
SELECT language, array_to_string(list(word ORDER BY line, word), ',') AS words FROM l GROUP BY language
""")
def words_by_language(spark, sf):
    rows = _table(spark, sf, "documents").groupBy(F.col("lang").alias("language"), F.col("source").alias("word")).agg(F.min("doc_id").alias("line"))
    return lexicon.by_language(rows).select("language", F.array_join("words", ",").alias("words"))


# ---- text ----------------------------------------------------------------------

# Titles in several scripts, which the driver's tables lack.
TITLES = ("나비야e", "나비야 e", "サクラモチ EX", "タケシ の オオグマ", "ヤマネコ", "N의 고양이", "山 猫 王", "Falcon VMAX", "オオグマGX", "Falcon V", "HP 70", "的")
_TITLE_ROWS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(TITLES))


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')))) AS key FROM documents")
def text_normalize(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(t.observation_key(F.col("text"))).alias("key"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title FROM documents")
def title_normalize(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", t.title(F.col("text")).alias("title"))


_LANG = r"""CASE WHEN x = '' THEN NULL WHEN regexp_matches(x, '[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]') THEN 'ja'
 WHEN regexp_matches(x, '[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]') THEN 'ko'
 WHEN contains(x, '的') OR regexp_full_match(x, '[\x{4E00}-\x{9FFF}]+') THEN 'zh-Hans'
 WHEN regexp_matches(x, '\p{L}') AND NOT regexp_matches(x, '[\x{4E00}-\x{9FFF}]') THEN 'en' END"""


@query(rf"""
WITH c AS (SELECT source AS g, text AS x FROM documents UNION ALL SELECT 'title' || (i % 3), x FROM (VALUES {_TITLE_ROWS}) v(i, x)),
y AS (SELECT g, trim(regexp_replace(x, '(\s*(VMAX|VSTAR|ex|EX|GX|V))+\s*$', '')) AS x FROM c),
l AS (SELECT g, {_LANG} AS language FROM y),
n AS (SELECT g, language, count(*) AS n FROM l WHERE language IS NOT NULL GROUP BY g, language)
SELECT g, language, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, list_position(['ja', 'ko', 'zh-Hans', 'en'], language)) AS k FROM n) WHERE k = 1
""")
def dominant_language(spark, sf):
    titles = spark.sql(f"select concat('title', i % 3) as g, x from values {_TITLE_ROWS} as v(i, x)")
    rows = _table(spark, sf, "documents", "source as g", "text as x").unionByName(titles)
    return keys.dominant(rows.select("g", t.language(F.col("x")).alias("language")), ["g"], "language", [*t.LANGUAGES])


_LINES = ("doc_id", "source", "text", "(doc_id % 100) / 100.0D as confidence", "struct(0.1D + (doc_id % 60) / 100.0D as x, 0.80D + (doc_id % 17) / 100.0D as y, 0.05D + (doc_id % 30) / 100.0D as w, 0.05D as h) as box")
_SCORE = r"""
WITH c AS (SELECT doc_id, source, text AS t, (doc_id % 100) / 100.0::DOUBLE AS c, 0.1::DOUBLE + (doc_id % 60) / 100.0::DOUBLE AS x,
  0.80::DOUBLE + (doc_id % 17) / 100.0::DOUBLE AS y, 0.05::DOUBLE + (doc_id % 30) / 100.0::DOUBLE AS w, 0.05::DOUBLE AS h FROM documents),
o AS (SELECT *, greatest(0, least(x + w, 0.75::DOUBLE) - greatest(x, 0.2::DOUBLE)) * greatest(0, least(y + h, 0.96::DOUBLE) - greatest(y, 0.85::DOUBLE)) / (w * h) AS share,
  length_grapheme(t) AS n, length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) AS digits FROM c),
s AS (SELECT *, c * 100 + CASE WHEN regexp_matches(t, '[\p{L}\p{M}]') THEN 45 ELSE 0 END + CASE WHEN regexp_matches(t, '\s(ex|EX|GX|V|VMAX|VSTAR)$') THEN 20 ELSE 0 END
  + CASE WHEN n BETWEEN 2 AND 18 THEN 15 ELSE -abs(n - 10) END - CASE WHEN digits > 0 THEN 35 ELSE 0 END - CASE WHEN digits / n >= 0.5 THEN 80 ELSE 0 END
  + CASE WHEN share >= 0.8 THEN 120 WHEN share >= 0.35 THEN 60 ELSE -90 END - CASE WHEN y < 0.85 THEN 20 ELSE 0 END
  - CASE WHEN x + w / 2 < 0.2 THEN 100 WHEN x < 0.2 THEN 50 ELSE 0 END - CASE WHEN w < 0.08 THEN 20 ELSE 0 END AS score
  FROM o WHERE t <> '' AND NOT contains(lower(replace(t, ' ', '')), 'hp') AND regexp_matches(t, '[\p{L}\p{M}]'))
"""


@query(_SCORE + "SELECT source, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, c DESC, doc_id) AS k FROM s) WHERE k = 1")
def title_rank(spark, sf):
    rows = _table(spark, sf, "documents", *_LINES)
    score = t.F.round(s.title_score(F.col("text"), F.col("confidence"), F.col("box"), g.rect(0.2, 0.85, 0.55, 0.11)), 6)
    return keys.best_of_each(rows.withColumn("score", score), ["source"], "score", F.desc("confidence"), F.asc("doc_id")).select("source", "doc_id", "score")


@query(r"""
SELECT doc_id, line, contains(lower(replace(x, ' ', '')), 'hp') AS junk,
  length_grapheme(x) BETWEEN 4 AND 20 AND regexp_full_match(x, '[\p{L}\p{M} ''-]*') AND regexp_matches(x, '[AEIOUaeiou]')
  AND NOT (length(regexp_replace(x, '[^\p{Lu}\p{Lt}]', '', 'g')) > length(regexp_replace(x, '[^\p{Ll}]', '', 'g')) AND length(regexp_replace(x, '[^\p{Ll}]', '', 'g')) <= 1) AS plausible,
  CASE WHEN length_grapheme(trim(x)) > 18 THEN substring_grapheme(trim(x), 1, 18) || '...' ELSE trim(x) END AS shown
FROM (SELECT doc_id, k - 1 AS line, l[k] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
""")
def title_predicates(spark, sf):
    rows = _lines(spark, sf)
    x = F.col("x")
    return rows.select("doc_id", "line", t.is_junk(x).alias("junk"), t.plausible_title(x).alias("plausible"), t.shortened(x).alias("shown"))


def _lines(spark, sf):
    """All lines of all documents, whole, as titles."""
    return _table(spark, sf, "documents", "doc_id", "posexplode(split(text, '\\n')) as (line, x)")


# ---- boxes and scores ------------------------------------------------------------

_BOX = "struct((l_partkey % 50) / 100.0D as x, (l_suppkey % 40) / 100.0D as y, (1 + l_partkey % 60) / 100.0D as w, (1 + l_orderkey % 70) / 100.0D as h) as box"
_CONF = "round(l_discount * 10, 2) as confidence"
_BOX_SQL = "(l_partkey % 50) / 100.0::DOUBLE AS x, (l_suppkey % 40) / 100.0::DOUBLE AS y, (1 + l_partkey % 60) / 100.0::DOUBLE AS w, (1 + l_orderkey % 70) / 100.0::DOUBLE AS h"


def _score_sql(conf: str, content: str) -> str:
    return f"""least(greatest({conf}, 0), 1) * 0.30 + (CASE WHEN a < 0.10 THEN a / 0.10 WHEN a <= 0.45 THEN 1 ELSE greatest(0, 1 - (a - 0.45) / 0.41) END) * 0.20
  + (CASE WHEN r < 0.45 THEN r / 0.45 WHEN r > 1.05 THEN greatest(0, 1 - (r - 1.05) / 0.20) ELSE 1 - abs(r - 63.0 / 88.0) / greatest(63.0 / 88.0 - 0.45, 1.05 - 63.0 / 88.0) * 0.45 END) * 0.20
  + {content} * 0.20 + 0.6 * 0.10"""


_SCORED_SQL = f"""
WITH b AS (SELECT l_orderkey, l_linenumber, round(l_discount * 10, 2) AS c, {_BOX_SQL} FROM lineitem),
m AS (SELECT *, w * h AS a, w / h AS r FROM b),
s AS (SELECT *, {_score_sql('c', '0.5')} AS score FROM m),
d AS (SELECT *, concat_ws(',', CASE WHEN c < 0.55 THEN 'lowConfidence' END, CASE WHEN w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > 1 OR y + h > 1 THEN 'invalidBounds' END,
  CASE WHEN a < 0.035 THEN 'tooSmall' END, CASE WHEN a > 0.86 THEN 'tooLarge' END, CASE WHEN r > 1.25 OR r < 0.32 OR r > 1.18 THEN 'unlikelyOrientation' END,
  CASE WHEN score < 0.55 THEN 'poorScore' END) AS reasons FROM s)
"""


def _detections(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", _CONF, _BOX)
    return rows.withColumn("d", s.detection(F.col("box"), F.col("confidence"))).select("l_orderkey", "l_linenumber", "confidence", "box", F.round("d.score", 9).alias("score"), F.array_join("d.reasons", ",").alias("reasons"))


@query(_SCORED_SQL + "SELECT l_orderkey, l_linenumber, round(score, 6) AS score, reasons FROM d")
def detection_score(spark, sf):
    return _detections(spark, sf).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "reasons")


@query(_SCORED_SQL + """
SELECT l_orderkey, count(*) FILTER (WHERE reasons = '') AS n_valid,
  arg_min(l_linenumber, (-round(score, 9), l_linenumber)) FILTER (WHERE reasons = '') AS best, arg_min(l_linenumber, (-round(score, 9), l_linenumber)) FILTER (WHERE reasons <> '') AS best_rejected
FROM d GROUP BY l_orderkey
""")
def best_detection(spark, sf):
    d = _detections(spark, sf)
    best = lambda ok: F.max(F.when(ok, F.struct("score", (-F.col("l_linenumber")).alias("back"))))
    good = F.col("reasons") == ""
    rows = d.groupBy("l_orderkey").agg(F.count_if(good).alias("n_valid"), best(good).alias("b"), best(~good).alias("r"))
    return rows.select("l_orderkey", "n_valid", (-F.col("b.back")).alias("best"), (-F.col("r.back")).alias("best_rejected"))


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber > 3 AS fallback, CASE WHEN l_linenumber > 3 THEN 0.62 ELSE round(l_discount * 10, 2) END AS c,
  CASE WHEN l_linenumber > 3 THEN 0.75 ELSE 0.5 END AS content, {_BOX_SQL} FROM lineitem),
m AS (SELECT *, w * h AS a, w / h AS r FROM b),
s AS (SELECT *, {_score_sql('c', 'content')} AS score FROM m),
d AS (SELECT *, c >= 0.55 AND x + w <= 1 AND y + h <= 1 AND a >= 0.035 AND a <= 0.86 AND r <= 1.18 AND r >= 0.32 AND score >= 0.55 AS good FROM s),
p AS (SELECT l_orderkey, bool_or(good AND NOT fallback) AS primary_found FROM d GROUP BY l_orderkey)
SELECT l_orderkey, arg_min(l_linenumber, (-round(score, 9), l_linenumber)) AS chosen, bool_or(fallback) AS by_fallback
FROM d JOIN p USING (l_orderkey) WHERE good AND (NOT primary_found OR NOT fallback) GROUP BY l_orderkey
""")
def fallback_detection(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "round(l_discount * 10, 2) as c", _BOX)
    score = lambda df, c, content: df.withColumn("d", s.detection(F.col("box"), c, content=F.lit(content)))
    primary = score(rows.where("l_linenumber <= 3"), F.col("c"), 0.5).withColumn("fallback", F.lit(False))
    second = score(rows.where("l_linenumber > 3"), F.lit(0.62), 0.75).withColumn("fallback", F.lit(True))
    good = primary.where("size(d.reasons) = 0")
    both = good.unionByName(keys.missing(second.where("size(d.reasons) = 0"), good, "l_orderkey")).withColumn("score", F.round("d.score", 9))
    best = keys.best_of_each(both, ["l_orderkey"], "score", F.asc("l_linenumber"))
    return best.select("l_orderkey", F.col("l_linenumber").alias("chosen"), F.col("fallback").alias("by_fallback"))


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX_SQL} FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, x * 600 AS x, (1 - (y + h)) * 1000 AS y, w * 600 AS w, h * 1000 AS h FROM b),
f AS (SELECT *, CASE WHEN w / h > 63.0 / 88.0 THEN w ELSE h * 63.0 / 88.0 END * 1.16 AS fw, CASE WHEN w / h > 63.0 / 88.0 THEN w / (63.0 / 88.0) ELSE h END * 1.16 AS fh FROM p),
u AS (SELECT *, x + w / 2 - fw / 2 AS ux, y + h / 2 - fh / 2 AS uy FROM f)
SELECT l_orderkey, l_linenumber, round(greatest(ux, 0), 4) AS x, round(greatest(uy, 0), 4) AS y, round(least(ux + fw, 600) - greatest(ux, 0), 4) AS w,
  round(least(uy + fh, 1000) - greatest(uy, 0), 4) AS h, ux < 0 OR uy < 0 OR ux + fw > 600 OR uy + fh > 1000 AS clipped FROM u
""")
def crop_projection(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", _BOX)
    c = g.crop_projection(g.to_pixels(F.col("box"), F.lit(600.0), F.lit(1000.0)), F.lit(600.0), F.lit(1000.0))
    rows = rows.select("l_orderkey", "l_linenumber", c.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(F.col(f"c.rect.{n}"), 4).alias(n) for n in "xywh"), F.col("c.clipped").alias("clipped"))


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX_SQL} FROM lineitem)
SELECT l_orderkey, l_linenumber, round(0.1 + x * 0.8, 6) AS px, round(0.5 + y * 0.5, 6) AS py, round(w * 0.8 * h * 0.5, 6) AS area,
  round(greatest(0, least(1, 1 - (y + h / 2))), 6) AS fx, round(greatest(0, least(1, 1 - (x + w / 2))), 6) AS fy, round(x * 300 + 50, 6) AS vx FROM b
""")
def region_projection(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", _BOX)
    p, f = g.from_region(F.col("box"), g.rect(0.1, 0.5, 0.8, 0.5)), g.focus_point(F.col("box"))
    v = g.aspect_scaled(F.col("box"), F.lit(600.0), F.lit(800.0), F.lit(400.0), F.lit(400.0), fill=False)
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(p["x"], 6).alias("px"), F.round(p["y"], 6).alias("py"), F.round(g.area(p), 6).alias("area"),
        F.round(f["x"], 6).alias("fx"), F.round(f["y"], 6).alias("fy"), F.round(v["x"], 6).alias("vx"),
    )


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY l_linenumber % 3 DESC, l_extendedprice) AS text, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def reading_order(spark, sf):
    """What the order leaves open is as in the table: by file and row, which a
    shuffle doesn't keep.  Lines without a price are the last of theirs, those
    without a text count but are not read."""
    item = "struct(l_extendedprice is null, _metadata.file_path, _metadata.row_index, concat(l_returnflag, l_linenumber) as text, l_extendedprice as x, (l_linenumber % 3) / 10.0D as y, 0.1D as w, 0.05D as h) as item"
    rows = _table(spark, sf, "lineitem", "l_orderkey", item)
    items = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.when(F.col("item.text").isNotNull(), F.col("item")))).alias("items"), F.count("*").alias("n"))
    return items.select("l_orderkey", F.nullif(folds.combined_text(F.col("items")), F.lit("")).alias("text"), "n")


@query("""
WITH RECURSIVE r AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n,
  {'said': l_orderkey || '-' || l_linenumber, 'x': (l_suppkey % 7) / 10.0::DOUBLE, 'm': (l_orderkey % 40) / 800.0::DOUBLE + 0.05::DOUBLE / 2} AS item FROM lineitem),
d AS (SELECT l_partkey, 1::BIGINT AS n, [item] AS done FROM r WHERE n = 1 UNION ALL
  SELECT l_partkey, n, done[:len(done) - rest] || [item] || done[len(done) - rest + 1:] FROM (SELECT d.l_partkey, r.n, r.item, d.done,
    coalesce(nullif(list_position(list_reverse(list_transform(d.done, lambda o: CASE WHEN abs(r.item.m - o.m) > 0.025::DOUBLE THEN r.item.m > o.m ELSE r.item.x < o.x END)), false), 0), len(d.done) + 1) - 1 AS rest
    FROM d JOIN r ON r.l_partkey = d.l_partkey AND r.n = d.n + 1))
SELECT l_partkey, n, array_to_string(list_transform(done, lambda o: o.said), chr(10)) AS text FROM d QUALIFY n = max(n) OVER (PARTITION BY l_partkey)
""")
def reading_order_drift(spark, sf):
    """Boxes whose middles drift, so that no order suits all comparisons."""
    rows = _table(spark, sf, "lineitem", "l_partkey", "struct(l_orderkey, l_linenumber, l_suppkey, concat(l_orderkey, '-', l_linenumber) as text, (l_suppkey % 7) / 10.0D as x, (l_orderkey % 40) / 800.0D as y, 0.1D as w, 0.05D as h) as item")
    items = rows.groupBy("l_partkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return items.select("l_partkey", F.size("items").cast("long").alias("n"), folds.combined_text(F.col("items")).alias("text"))


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS text_key, l_discount AS c, (l_partkey % 5) / 10.0::DOUBLE AS x, (l_suppkey % 4) / 10.0::DOUBLE AS y,
  [l_linestatus, 'P' || l_partkey % 3, 'p' || l_suppkey % 3] AS said FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, text_key ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM l),
f AS (SELECT l_orderkey, text_key, n, [{'x': x, 'y': y, 'c': c}] AS st, 0 AS slot, true AS over FROM r WHERE n = 1
  UNION ALL SELECT l_orderkey, text_key, n, CASE WHEN pos = 0 THEN list_append(st, me) WHEN c > st[pos].c THEN list_concat(list_concat(st[1:pos - 1], [me]), st[pos + 1:]) ELSE st END,
    CASE WHEN pos = 0 THEN len(st) ELSE pos - 1 END, pos = 0 OR c > st[pos].c
  FROM (SELECT r.l_orderkey, r.text_key, r.n, r.c, f.st, {'x': r.x, 'y': r.y, 'c': r.c} AS me, coalesce(list_position(list_transform(f.st, lambda o:
    greatest(0, 0.4 - abs(o.x - r.x)) * greatest(0, 0.3 - abs(o.y - r.y)) / (0.24 - greatest(0, 0.4 - abs(o.x - r.x)) * greatest(0, 0.3 - abs(o.y - r.y))) >= 0.35), true), 0) AS pos
    FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.text_key = f.text_key AND r.n = f.n + 1)),
m AS (SELECT r.*, f.slot, CASE WHEN f.over THEN -r.n ELSE r.n END AS turn FROM r JOIN f USING (l_orderkey, text_key, n)),
g AS (SELECT l_orderkey, text_key, slot, count(*) AS merged, min((l_linenumber, l_partkey, l_suppkey)) AS begun, arg_min(l_linenumber, (-c, l_linenumber)) AS l_linenumber FROM m GROUP BY ALL),
k AS (SELECT l_orderkey, text_key, slot, turn, unnest(range(3)) AS i, unnest(said) AS t FROM m),
u AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, text_key, slot, lower(t) ORDER BY turn, i) AS nth FROM k),
s AS (SELECT l_orderkey, text_key, slot, string_agg(t, '|' ORDER BY turn, i) AS every, string_agg(t, '|' ORDER BY turn, i) FILTER (WHERE nth = 1) AS once FROM u GROUP BY ALL)
SELECT l_orderkey, l_linenumber, text_key, merged, row_number() OVER (PARTITION BY l_orderkey ORDER BY begun, text_key) - 1 AS place, CASE WHEN merged = 1 THEN every ELSE once END AS candidates
FROM g JOIN s USING (l_orderkey, text_key, slot)
""")
def ordered_dedup(spark, sf):
    said = "array(struct(l_linestatus as text), struct(concat('P', l_partkey % 3) as text), struct(concat('p', l_suppkey % 3) as text)) as candidates"
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag as text_key", "l_discount as confidence", "(l_partkey % 5) / 10.0D as x", "(l_suppkey % 4) / 10.0D as y", "0.4D as w", "0.3D as h", said)
    found = folds.deduplicated(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "text_key", "merged", "place", F.array_join(F.transform("candidates", lambda c: c["text"]), "|").alias("candidates"))


# ---- grids -----------------------------------------------------------------------

_GRID = """
WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 100 AS v FROM embeddings),
p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, v FROM v),
n AS (SELECT a.vec_id, a.x, a.y, a.v, b.x - a.x AS dx, b.y - a.y AS dy, b.v AS w FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
  WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6),
k AS (SELECT vec_id, x, y, sum(CASE WHEN abs(dx) + abs(dy) = 1 THEN w WHEN dx = 0 AND dy = 0 THEN -4 * w ELSE 0 END) AS lap,
  sum(dx * w * (2 - abs(dy))) AS gx, sum(dy * w * (2 - abs(dx))) AS gy FROM n GROUP BY vec_id, x, y),
f AS (SELECT vec_id, var_pop(lap) AS sharpness, avg(sqrt(gx * gx + gy * gy)) AS gradient FROM k GROUP BY vec_id),
s AS (SELECT vec_id, avg(v) AS brightness, stddev_pop(v) AS contrast FROM p GROUP BY vec_id)
"""


def _grids(spark, sf):
    rows = _table(spark, sf, "embeddings", "vec_id", "transform(embedding, x -> cast(x as double) * 100) as v")
    m, eight = grids.mean_and_std(F.col("v")), F.lit(8)
    return rows.select("vec_id", "v", m.alias("m"), grids.laplacian_variance(F.col("v"), eight, eight).alias("sharpness"), grids.tenengrad(F.col("v"), eight, eight).alias("gradient"))


@query(_GRID + "SELECT vec_id, round(sharpness, 4) AS sharpness, round(gradient, 4) AS gradient, round(brightness, 4) AS brightness, round(contrast, 4) AS contrast FROM f JOIN s USING (vec_id)")
def focus_metrics(spark, sf):
    return _grids(spark, sf).select("vec_id", F.round("sharpness", 4).alias("sharpness"), F.round("gradient", 4).alias("gradient"), F.round("m.mean", 4).alias("brightness"), F.round("m.std", 4).alias("contrast"))


@query(_GRID + """
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'waitingForAutofocus' WHEN round(brightness, 4) + 35 < 35 THEN 'tooDark' WHEN round(contrast, 4) < 18 AND vec_id % 2 = 0 THEN 'tooLowContrast'
  WHEN round(sharpness, 4) < 120 OR round(gradient, 4) < 18 THEN CASE WHEN vec_id % 3 = 0 THEN 'tooCloseLikely' ELSE 'tooBlurry' END ELSE 'focused' END AS reason
FROM f JOIN s USING (vec_id)
""")
def focus_reason(spark, sf):
    rows = focus_metrics(spark, sf)
    contrast = F.when(F.col("vec_id") % 2 == 0, F.col("contrast")).otherwise(100.0)
    area = F.when(F.col("vec_id") % 3 == 0, 0.9).otherwise(0.1)
    return rows.select("vec_id", s.focus_reason(F.col("sharpness"), F.col("gradient"), F.col("brightness") + 35, contrast, area, F.col("vec_id") % 10 == 0).alias("reason"))


@query("SELECT vec_id, round(avg(v) FILTER (WHERE x < 2 OR x >= 6 OR y < 2 OR y >= 6), 6) AS border FROM (SELECT vec_id, i % 8 AS x, i // 8 AS y, v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)) GROUP BY vec_id")
def border_mean(spark, sf):
    rows = _table(spark, sf, "embeddings", "vec_id", "transform(embedding, x -> cast(x as double)) as v")
    return rows.select("vec_id", F.round(grids.border_mean(F.col("v"), F.lit(8), F.lit(8)), 6).alias("border"))


def _components_sql(cells: str) -> str:
    """Components of cells (vec_id, i of an 8 x 8 grid) by reachability."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
p AS ({cells}),
e AS (SELECT a.vec_id, a.i, b.i AS j FROM p a JOIN p b ON a.vec_id = b.vec_id AND ((abs(a.i - b.i) = 8) OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8))),
rec AS (SELECT vec_id, i, i AS r FROM p UNION SELECT rec.vec_id, e.j, rec.r FROM rec JOIN e ON e.vec_id = rec.vec_id AND e.i = rec.i),
l AS (SELECT vec_id, i, min(r) AS root FROM rec GROUP BY vec_id, i),
c AS (SELECT vec_id, root, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS w, max(i // 8) - min(i // 8) + 1 AS h, count(*) AS pixels FROM l GROUP BY vec_id, root)
"""


_NUMBERED = "SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY root) - 1 AS component, x, y, w, h, pixels"


@query(_components_sql("SELECT vec_id, i FROM v WHERE v > 0.1") + _NUMBERED + ", round(pixels / 64.0 * 3 + greatest(0, 1 - least(abs(w / h - 63.0 / 88.0) / (63.0 / 88.0), 1)) * 2, 6) AS score FROM c")
def components(spark, sf):
    rows = _table(spark, sf, "embeddings", "vec_id", "transform(embedding, x -> x > 0.1) as m", "8 as w", "8 as h")
    found = grids.components(rows, "vec_id", "m", "w", "h")
    score = s.component_score(F.col("w"), F.col("h"), F.col("pixels"), F.lit(64.0))
    return found.withColumn("score", F.round(score, 6))


@query(_components_sql("SELECT DISTINCT a.vec_id, b.i FROM v a JOIN (SELECT unnest(range(64)) AS i) b ON a.v > 0.2 AND abs(a.i % 8 - b.i % 8) <= 1 AND abs(a.i // 8 - b.i // 8) <= 1") + _NUMBERED
       + ", round(pixels / 64.0 * 3 + pixels / (w * h) + greatest(0, 1 - least(abs(w / h - 63.0 / 88.0), 1)) + CASE WHEN (y + h / 2) / 8 > 0.18 THEN 1 ELSE 0.6 END, 6) AS score FROM c")
def dilated_components(spark, sf):
    """Components of grown masks, scored as crops."""
    rows = _table(spark, sf, "embeddings", "vec_id", "transform(embedding, x -> x > 0.2) as m", "8 as w", "8 as h")
    found = grids.components(rows, "vec_id", "m", "w", "h", radius=1)
    score = s.crop_component_score(F.struct("x", "y", "w", "h"), F.col("pixels"), F.lit(8.0), F.lit(8.0))
    return found.withColumn("score", F.round(score, 6))


@query(_components_sql("SELECT vec_id, i FROM v WHERE v > -0.05") + """
, g AS (SELECT vec_id, root, 2 * x AS x, 2 * y AS y, 2 * w AS w, 2 * h AS h, 4 * pixels AS pixels FROM c),
s AS (SELECT *, round(pixels / 256.0 * 3 + greatest(0, 1 - least(abs(w / h - 63.0 / 88.0) / (63.0 / 88.0), 1)) * 2, 6) AS score FROM g
  WHERE w >= 10 AND h >= 10 AND pixels / 256.0 >= 0.035 * 0.45 AND pixels / 256.0 <= 0.86 AND w / h <= 1.25)
SELECT vec_id, x, y, w, h, pixels, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, root) AS n FROM s) WHERE n = 1
""")
def best_component(spark, sf):
    """The card-like component of each grid, which is doubled to 16 x 16."""
    rows = _table(spark, sf, "embeddings", "vec_id", "transform(sequence(0, 255), i -> embedding[(i div 32) * 8 + (i % 16) div 2] > -0.05) as m", "16 as w", "16 as h")
    found = grids.detected_components(grids.components(rows, "vec_id", "m", "w", "h"), F.lit(256.0))
    found = found.withColumn("score", F.round(s.component_score(F.col("w"), F.col("h"), F.col("pixels"), F.lit(256.0)), 6))
    return grids.best_component(found, "vec_id", "score").drop("component")


# ---- sequences -------------------------------------------------------------------

_FRAMES = (
    "user_id % 50 as session_id", "event_id as seq", "round(value, 3) as score", "event_id % 5 <> 0 as is_sharp", "event_id % 17 = 0 as is_adjusting",
    "if(event_id % 13 = 0, null, struct(0.2D + (event_id % 3) * 0.005D + if(event_id % 7 = 0, 0.2D, 0.0D) as x, 0.15D as y, 0.36D as w, 0.5D as h)) as box",
)
_FRAMES_SQL = """
WITH f AS (SELECT user_id % 50 AS session_id, event_id AS seq, round(value, 3) AS score, event_id % 5 <> 0 AS sharp, event_id % 17 = 0 AS adjusting,
  event_id % 13 <> 0 AS there, 0.2::DOUBLE + (event_id % 3) * 0.005::DOUBLE + CASE WHEN event_id % 7 = 0 THEN 0.2::DOUBLE ELSE 0 END AS x FROM events),
p AS (SELECT *, lag(there) OVER w AS pt, lag(x) OVER w AS px FROM f WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
q AS (SELECT *, coalesce(there AND pt AND abs(x - px) <= 0.06 AND (0.36 - abs(x - px)) / (0.36 + abs(x - px)) >= 0.65, false) AS steady FROM p),
r AS (SELECT *, sum(CASE WHEN steady THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS run, there AND sharp AND NOT adjusting AS eligible FROM q),
c AS (SELECT *, CASE WHEN there THEN row_number() OVER (PARTITION BY session_id, run ORDER BY seq) ELSE 0 END AS stable_count,
  sum(CASE WHEN eligible THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, run ORDER BY seq) AS brk FROM r),
d AS (SELECT *, CASE WHEN eligible THEN count(*) FILTER (WHERE eligible) OVER (PARTITION BY session_id, run, brk ORDER BY seq) ELSE 0 END AS focused_count FROM c),
e AS (SELECT *, stable_count >= 3 AND focused_count >= 2 AS fires FROM d),
l AS (SELECT *, coalesce(sum(CASE WHEN fires THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS live FROM e)
"""


@query(_FRAMES_SQL + "SELECT session_id, seq, live AND fires AS should_capture, live AND stable_count >= 3 AS is_stable, live AND eligible AS is_eligible, live AND (NOT there OR (coalesce(pt, false) AND NOT steady)) AS did_reset FROM l")
def gate_capture(spark, sf):
    return gate.decisions(_table(spark, sf, "events", *_FRAMES)).select("session_id", "seq", "should_capture", "is_stable", "is_eligible", "did_reset")


@query(_FRAMES_SQL + """
, h AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY seq) AS k FROM l WHERE there AND sharp)
SELECT a.session_id, a.seq AS capture_seq, arg_min(b.seq, (-b.score, b.seq)) AS best_seq, max(b.score) AS best_score
FROM h a JOIN h b ON a.session_id = b.session_id AND a.run = b.run AND b.k BETWEEN a.k - 7 AND a.k WHERE a.live AND a.fires GROUP BY a.session_id, a.seq
""")
def best_frame(spark, sf):
    return gate.best_frames(gate.decisions(_table(spark, sf, "events", *_FRAMES)))


_STEPS = ("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6D / 864000D as t")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE / 864000::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS accepted, t AS last FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.t - f.last >= 0.25, CASE WHEN e.t - f.last >= 0.25 THEN e.t ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, accepted FROM f
""")
def throttle(spark, sf):
    rows = folds.throttle(_table(spark, sf, "events", *_STEPS), ["user_id"], ["t", "event_id"])
    return rows.select("user_id", "event_id", "accepted")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE / 864000::DOUBLE AS t, (event_id % 10) / 10.0::DOUBLE AS px, event_id % 3 = 0 AS soft,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS requested, t AS asked_at, px AS x, 0 AS blurry, true AS settling FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, asked, CASE WHEN asked THEN t ELSE asked_at END, CASE WHEN asked THEN px ELSE x END, CASE WHEN asked THEN 0 ELSE b END, asked OR t - asked_at < 0.60 FROM (
    SELECT e.user_id, e.event_id, e.n, e.t, e.px, f.asked_at, f.x, CASE WHEN e.soft THEN f.blurry + 1 ELSE 0 END AS b,
      (abs(e.px - f.x) >= 0.08 OR (e.soft AND f.blurry + 1 >= 2)) AND e.t - f.asked_at >= 0.80 AS asked FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, event_id, requested, settling FROM f
""")
def refocus(spark, sf):
    rows = _table(spark, sf, "events", *_STEPS, "(event_id % 10) / 10.0D as px", "0.5D as py", "if(event_id % 3 = 0, 'tooBlurry', 'focused') as reason")
    return folds.refocus(rows, ["user_id"], ["t", "event_id"]).select("user_id", "event_id", "requested", "settling")


@query("""
WITH g AS (SELECT DISTINCT source, CASE WHEN length(source) % 3 = 0 THEN 'ko' WHEN length(source) % 3 = 1 THEN 'en' END AS lang FROM documents),
p(ordinal, languages) AS (VALUES (0, 'ja-JP'), (1, 'ko-KR'), (2, 'zh-Hans,zh-Hant'), (3, 'en-US,fr-FR,de-DE,it-IT,es-ES'))
SELECT source, languages, row_number() OVER (PARTITION BY source ORDER BY coalesce((lang = 'ko' AND ordinal = 1) OR (lang = 'en' AND ordinal = 3), false) DESC, ordinal) AS place FROM g, p
""")
def pass_plan(spark, sf):
    groups = _table(spark, sf, "documents", "source", "case when length(source) % 3 = 0 then 'ko' when length(source) % 3 = 1 then 'en' end as lang").distinct()
    return passes.ordered(groups, "lang").select("source", F.array_join("languages", ",").alias("languages"), "place")


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, k - 1 AS line, l[k] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM l)),
f AS (SELECT *, regexp_full_match(x, '[\p{L}\p{M} ''-]*') AND length_grapheme(x) BETWEEN 4 AND 20 AND regexp_matches(x, '[AEIOUaeiou]')
  AND NOT (length(regexp_replace(x, '[^\p{Lu}\p{Lt}]', '', 'g')) > length(regexp_replace(x, '[^\p{Ll}]', '', 'g')) AND length(regexp_replace(x, '[^\p{Ll}]', '', 'g')) <= 1)
  AND regexp_matches(trim(regexp_replace(x, '(\s*(VMAX|VSTAR|ex|EX|GX|V))+\s*$', '')), '\p{L}') AS good FROM r),
d AS (SELECT *, coalesce(max(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM f)
SELECT doc_id, line FROM d WHERE done = 0
""")
def supplemental_passes(spark, sf):
    """Each line of a document as the title that one more pass finds."""
    rows = _lines(spark, sf).withColumn("dominant", F.lit("en"))
    return passes.until_satisfied(rows, "doc_id", "line", "x", "dominant").select("doc_id", "line")


# ---- logs ------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN 200 + event_id % 300 >= 400 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_type = 'view' THEN '[Redacted]' ELSE props END AS shown,
  CASE WHEN event_id % 4 = 0 THEN '/path/' || event_id WHEN event_id % 4 = 1 THEN '/path/' || event_id WHEN event_id % 4 = 2 THEN '/path/' || event_id ELSE '/route' END AS route, round(abs(value), 2) AS ms,
  CASE WHEN event_id % 2 = 0 THEN 'set' ELSE CAST(user_id AS VARCHAR) END AS who FROM events
""")
def log_records(spark, sf):
    rows = _table(spark, sf, "events")
    e = F.col("event_id")
    route = F.when(e % 4 == 0, "*").when(e % 4 == 1, "").when(e % 4 == 2, "/api/*").otherwise("/route")
    return rows.select(
        "event_id", logs.outcome(200 + e % 300).alias("outcome"), logs.redacted(F.when(F.col("event_type") == "view", "token").otherwise("props"), F.col("props")).alias("shown"),
        logs.route(route, F.concat(F.lit("/path/"), e.cast("string"))).alias("route"), logs.duration(F.abs("value")).alias("ms"),
        logs.user(F.when(e % 2 == 0, "set").otherwise(""), F.col("user_id").cast("string")).alias("who"),
    )


@query("SELECT event_id, 'api' AS service, '[Redacted]' AS token, '[Redacted]' AS auth, event_type AS kind, '[Redacted]' AS body, value FROM events")
def redacted_log(spark, sf):
    """Events written as log records by the sink, and read back as JSON."""
    log_sink.register(spark)
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    headers = F.struct(F.col("props").alias("authorization"), F.col("event_type").alias("kind"))
    rows = _table(spark, sf, "events").select("event_id", F.col("event_type").alias("token"), F.struct(headers.alias("headers")).alias("req"), F.struct("user_id").alias("body"), "value")
    rows.write.format("redacted_log").option("base", '{"service": "api"}').mode("append").save(path)
    back = spark.read.schema("event_id long, service string, token string, req struct<headers: struct<authorization: string, kind: string>>, body string, value double").json(path)
    return back.select("event_id", "service", "token", F.col("req.headers.authorization").alias("auth"), F.col("req.headers.kind").alias("kind"), "body", "value")


@query("SELECT event_id, k AS step, CASE WHEN k = 0 THEN 'started' WHEN 200 + event_id % 300 >= 400 THEN 'failed' ELSE 'completed' END AS event FROM events, (VALUES (0), (1)) v(k)")
def request_events(spark, sf):
    return logs.lifecycle(_table(spark, sf, "events", "event_id", "200 + event_id % 300 as status")).select("event_id", "step", "event")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import recognition  # noqa: F401  registers its queries here

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from . import recognition  # noqa: F401

    return dict(SQL)
