"""Registered queries of the recognition operators: regions, crops, shapes,
candidates of several passes, states and what is shown of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g, scores as s, text as t
from ..operators import folds, gate, grids, images, keys, observations, passes
from ..sources import catalogue_feed as feed, lexicon, logs, store
from .catalogue import _BOX, _BOX_SQL, _CONF, _FRAMES, _FRAMES_SQL, _components_sql, _score_sql, _table, query

# ---- regions ---------------------------------------------------------------------

_SIZE = ("cast(300 + l_partkey % 400 as double) as iw", "cast(400 + l_suppkey % 500 as double) as ih")
_SIZE_SQL = "(300 + l_partkey % 400)::DOUBLE AS iw, (400 + l_suppkey % 500)::DOUBLE AS ih"


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX_SQL}, {_SIZE_SQL} FROM lineitem),
r AS (SELECT *, iw * 0.20 AS tx, ih * 0.02 AS ty, iw * 0.55 AS tw, ih * 0.11 AS th FROM b),
n AS (SELECT *, tx / iw AS nx, 1 - (ty + th) / ih AS ny, tw / iw AS nw, th / ih AS nh FROM r),
q AS (SELECT *, greatest(nx - 0.10, 0) AS sx, greatest(ny - 0.07, 0) AS sy, least(nx + nw + 0.10, 1) AS sr, least(ny + nh + 0.07, 1) AS st,
  greatest(nx - 0.06, 0) AS ax, greatest(ny - 0.04, 0) AS ay, least(nx + nw + 0.06, 1) AS ar, least(ny + nh + 0.04, 1) AS au, x - 0.03 AS wx, y - 0.025 AS wy, x + w + 0.03 AS wr, y + h + 0.025 AS wt FROM n),
f AS (SELECT *, least(ar, wr) - greatest(ax, wx) > 0 AND least(au, wt) - greatest(ay, wy) > 0 AS inside FROM q)
SELECT l_orderkey, l_linenumber, round(nx, 6) AS nx, round(ny, 6) AS ny, round(sx, 6) AS sx, round(sr - sx, 6) AS sw, round(st - sy, 6) AS sh,
  round(CASE WHEN inside THEN greatest(ax, wx) ELSE wx END, 6) AS fx, round(CASE WHEN inside THEN least(au, wt) - greatest(ay, wy) ELSE wt - wy END, 6) AS fh FROM f
""")
def title_regions(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", _BOX, *_SIZE)
    n, q = g.title_region(F.col("iw"), F.col("ih")), g.search_region(F.col("iw"), F.col("ih"))
    rows = rows.select("l_orderkey", "l_linenumber", "box", n.alias("n"), q.alias("q")).withColumn("f", g.focused_region(F.col("box"), F.col("n")))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(F.col(c), 6).alias(c.replace(".", "").replace("q", "s")) for c in ("n.x", "n.y", "q.x", "q.w", "q.h", "f.x", "f.h")))


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX_SQL}, {_SIZE_SQL} FROM lineitem),
s AS (SELECT *, greatest(300 / iw, 500 / ih) AS k FROM b),
p AS (SELECT *, greatest(x * 600 - 20, 0) AS px, greatest(y * 600 - 20, 0) AS py, least(x * 600 - 20 + w * 600, iw) AS pr, least(y * 600 - 20 + h * 600, ih) AS pb FROM s)
SELECT l_orderkey, l_linenumber, round(x * iw * k + (300 - iw * k) / 2, 6) + 0 AS vx, round((1 - (y + h)) * ih * k + (500 - ih * k) / 2, 6) + 0 AS vy, round(w * iw * k, 6) AS vw,
  CASE WHEN pr >= px AND pb >= py THEN round(px / iw, 6) + 0 ELSE 0 END AS nx, CASE WHEN pr >= px AND pb >= py THEN round(1 - pb / ih, 6) + 0 ELSE 0 END AS ny,
  CASE WHEN pr >= px AND pb >= py THEN round((pr - px) / iw, 6) + 0 ELSE 0 END AS nw FROM p
""")
def view_projection(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", _BOX, *_SIZE)
    v = g.aspect_scaled(F.col("box"), F.col("iw"), F.col("ih"), F.lit(300.0), F.lit(500.0), fill=True)
    pixels = g.rect(F.col("box.x") * 600 - 20, F.col("box.y") * 600 - 20, F.col("box.w") * 600, F.col("box.h") * 600)
    rows = rows.withColumn("v", v).withColumn("p", pixels).withColumn("n", g.to_normalised(F.col("p"), F.col("iw"), F.col("ih")))
    shown = [F.round(F.col(f"v.{n}"), 6).alias(f"v{n}") for n in "xyw"] + [F.round(F.col(f"n.{n}"), 6).alias(f"n{n}") for n in "xyw"]
    return rows.select("l_orderkey", "l_linenumber", *shown)


_CORNERS_SQL = """x + (l_partkey % 3) * 0.0213 AS ax, y + h AS ay, x + w - (l_suppkey % 5) * 0.1031 AS bx, y + h - (l_suppkey % 7) * 0.0517 AS "by", x + w AS cx, y AS cy, x AS dx, y + (l_partkey % 4) * 0.0319 AS dy"""


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * 10, 2) AS c, {_BOX_SQL} FROM lineitem),
k AS (SELECT *, {_CORNERS_SQL} FROM b),
t AS (SELECT *, (bx - ax) * (cy - "by") - ("by" - ay) * (cx - bx) AS t1, (cx - bx) * (dy - cy) - (cy - "by") * (dx - cx) AS t2, (dx - cx) * (ay - dy) - (dy - cy) * (ax - dx) AS t3,
  (ax - dx) * ("by" - ay) - (ay - dy) * (bx - ax) AS t4, (sqrt((ax - bx) ** 2 + (ay - "by") ** 2) + sqrt((dx - cx) ** 2 + (dy - cy) ** 2)) / 2 AS mw,
  (sqrt((ax - dx) ** 2 + (ay - dy) ** 2) + sqrt((bx - cx) ** 2 + ("by" - cy) ** 2)) / 2 AS mh FROM k),
r AS (SELECT *, NOT (greatest(t1, t2, t3, t4) > 0.0001 AND least(t1, t2, t3, t4) < -0.0001) AS convex, CASE WHEN mh > 0 THEN mw / mh ELSE 0 END AS plain, CASE WHEN mh > 0 THEN mw * 0.7531 / mh ELSE 0 END AS ratio,
  w * 0.7531 / h AS bounding, w * h AS a, greatest(ax, bx, cx, dx) - least(ax, bx, cx, dx) AS sx, greatest(ay, "by", cy, dy) - least(ay, "by", cy, dy) AS sy FROM t),
s AS (SELECT *, CASE WHEN NOT convex OR sx <= 0 OR sy <= 0 THEN 0.1 WHEN plain > 0.28 AND plain < 1.22 THEN 1.0 ELSE 0.35 END AS shape FROM r),
f AS (SELECT *, least(greatest(c, 0), 1) * 0.30 + (CASE WHEN a < 0.10 THEN a / 0.10 WHEN a <= 0.45 THEN 1 ELSE greatest(0, 1 - (a - 0.45) / 0.41) END) * 0.20
  + (CASE WHEN ratio <= 0 THEN 0 WHEN ratio < 0.45 THEN ratio / 0.45 WHEN ratio > 1.05 THEN greatest(0, 1 - (ratio - 1.05) / 0.20) ELSE 1 - abs(ratio - 63.0 / 88.0) / greatest(63.0 / 88.0 - 0.45, 1.05 - 63.0 / 88.0) * 0.45 END) * 0.20
  + 0.5 * 0.20 + shape * 0.10 AS score FROM s)
SELECT l_orderkey, l_linenumber, convex, round(ratio, 6) AS ratio, shape::DOUBLE AS shape, round(score, 6) AS score, bounding > 1.25 OR ratio < 0.32 OR ratio > 1.18 AS turned FROM f
""")
def corner_scores(spark, sf):
    """Detections with corners on images that aren't square."""
    at = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    x, y, w, h = "box.x", "box.y", "box.w", "box.h"
    by = lambda key, n, step: f"cast(({key} % {n}) * {step}BD as double)"  # noqa: E731  an exact decimal, as a double may miss it by a digit
    corners = (
        f"named_struct('tl', {at(f'{x} + ' + by('l_partkey', 3, '0.0213'), f'{y} + {h}')}, 'tr', {at(f'{x} + {w} - ' + by('l_suppkey', 5, '0.1031'), f'{y} + {h} - ' + by('l_suppkey', 7, '0.0517'))}, "
        f"'br', {at(f'{x} + {w}', y)}, 'bl', {at(x, f'{y} + ' + by('l_partkey', 4, '0.0319'))}) as corners"
    )
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _CONF, _BOX).selectExpr("*", corners)
    rows = s.with_detection(rows, "d", "box", F.col("confidence"), "corners", F.lit(0.7531))
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6  # noqa: E731  of the double, as SQL rounds it; Spark's round is of its shortest decimal
    return rows.select(
        "l_orderkey", "l_linenumber", "d.convex", six("d.ratio").alias("ratio"), "d.shape", six("d.score").alias("score"), F.array_contains("d.reasons", "unlikelyOrientation").alias("turned")
    )


# ---- grids -----------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, v FROM v)
SELECT vec_id, round(avg(v) FILTER (WHERE y < 3), 6) AS title, count(*) FILTER (WHERE y < 3) AS title_pixels, round(avg(v) FILTER (WHERE y >= 2 AND y < 6), 6) AS middle, round(avg(v), 6) AS whole,
  round(avg(v) FILTER (WHERE x < 6 AND x >= 1 AND y >= 2 AND y < 5), 6) AS crop, round(avg(v) FILTER (WHERE x IN (2, 3) AND y IN (4, 5)), 6) AS reduced FROM p GROUP BY vec_id
""")
def grid_crops(spark, sf):
    rows = _table(spark, sf, "embeddings", "vec_id", "transform(embedding, x -> cast(x as double)) as v")
    v, eight = F.col("v"), F.lit(8)
    none = F.lit(None).cast("struct<x: double, y: double, w: double, h: double>")
    rows = rows.select(
        "vec_id", grids.title_band(v, eight, eight).alias("t"), grids.region_of_pass(v, eight, eight, g.rect(0, 0.32, 1, 0.36)).alias("m"), grids.region_of_pass(v, eight, eight, none).alias("a"),
        grids.cropped(v, eight, eight, g.rect(1.2, 2.5, 4.1, 2.5)).alias("c"), grids.downsampled(v, eight, eight, 4).alias("r"),
    )
    mean = lambda c: F.round(grids._mean(c), 6)
    return rows.select(
        "vec_id", mean(F.col("t.values")).alias("title"), F.size("t.values").alias("title_pixels"), mean(F.col("m.values")).alias("middle"), mean(F.col("a.values")).alias("whole"),
        mean(F.col("c.values")).alias("crop"), F.round(F.get(F.col("r.values"), F.lit(9)), 6).alias("reduced"),
    )


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_quantity / 50)::DOUBLE AS r, (l_partkey % 100) / 100.0::DOUBLE AS g, (l_suppkey % 50) / 50.0::DOUBLE AS b, (l_orderkey % 10) / 10.0::DOUBLE + 0.0113 AS br FROM lineitem),
q AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l, 0.299 * r + 0.587 * g + 0.114 * b AS f, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s,
  0.2126 * br + 0.7152 * 0.6137 + 0.0722 * 0.5071 AS bl, (greatest(br, 0.6137) - least(br, 0.5071)) / greatest(br, 0.6137) AS bs, (abs(r - br) + abs(g - 0.6137) + abs(b - 0.5071)) / 3 AS d FROM p)
SELECT l_orderkey, l_linenumber, round(l, 6) AS luma, round(f, 6) AS focus_luma, round(s, 6) AS saturation,
  (l) > (bl + 0.16) OR (bl > 0.55 AND (l) < (bl - 0.12)) OR (bl > 0.55 AND (d) > 0.14)
    OR ((s) > (greatest(0.18, bs + 0.14)) AND ((l) > (bl + 0.16) OR (bl > 0.55 AND (l) < (bl - 0.12)) OR (d) > 0.08)) AS in_crop,
  (bl > 0.55 AND (l) < (bl - 0.10) AND ((s) > 0.08 OR (l) < (bl - 0.20))) OR ((s) > (bs + 0.12) AND (abs(l - bl)) > 0.04) AS in_shape FROM q
""")
def pixel_masks(spark, sf):
    """Both rule sets of the foreground, on colours that give no ties."""
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity / 50 as r", "(l_partkey % 100) / 100.0D as g", "(l_suppkey % 50) / 50.0D as b", "(l_orderkey % 10) / 10.0D + 0.0113D as br")

    def pixel(r, gr, b):
        return F.struct(r.alias("r"), gr.alias("g"), b.alias("b"), grids.luma(r, gr, b, video=True).alias("luma"), grids.saturation(r, gr, b).alias("saturation"))

    p, e = pixel(F.col("r"), F.col("g"), F.col("b")), pixel(F.col("br"), F.lit(0.6137), F.lit(0.5071))
    return rows.select("l_orderkey", "l_linenumber", p.alias("p"), e.alias("e"), F.round(grids.luma(F.col("r"), F.col("g"), F.col("b")), 6).alias("focus_luma")).select(
        "l_orderkey", "l_linenumber", F.round("p.luma", 6).alias("luma"), "focus_luma", F.round("p.saturation", 6).alias("saturation"), grids.crop_foreground(F.col("p"), F.col("e")).alias("in_crop"),
        grids.foreground(F.col("p.luma"), F.col("p.saturation"), F.col("e.luma"), F.col("e.saturation")).alias("in_shape"),
    )


# ---- candidates of several passes ---------------------------------------------------


@query("""
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n,
  CASE WHEN l_partkey % 3 = 0 THEN 'pass ' || l_linenumber || ' of ' || l_partkey END AS error, CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey % 3 END AS observations FROM lineitem),
s AS (SELECT l_orderkey, CAST(coalesce(sum(observations), 0) AS BIGINT) AS n, arg_min(error, n) FILTER (WHERE error IS NOT NULL) AS error FROM r GROUP BY l_orderkey)
SELECT l_orderkey, n, CASE WHEN n = 0 THEN error END AS error FROM s
""")
def first_failures(spark, sf):
    """Passes that failed or found nothing: the first error of orders without any observation."""
    rows = _table(spark, sf, "lineitem", "l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey) as place", "if(l_partkey % 3 = 0, concat('pass ', l_linenumber, ' of ', l_partkey), null) as error", "if(l_suppkey % 4 = 0, l_suppkey % 3, null) as observations")
    return passes.outcomes(rows, "l_orderkey", "place")


@query("""
WITH l AS (SELECT l_orderkey, l_partkey % 4 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n,
  ['カ', 'ｶ', ' カ'][1 + l_suppkey % 3] || [['1', '①', '１'], ['ａ', 'A', 'a'], ['ﬁ', 'fi', 'FI'], ['㍍', 'メートル', 'ﾒｰﾄﾙ']][1 + l_partkey % 4][1 + l_linenumber % 3] AS said FROM lineitem),
f AS (SELECT l_orderkey, k, min(n) AS n, arg_min(said, n) AS said FROM l GROUP BY l_orderkey, k)
SELECT l_orderkey, count(*) AS kept, string_agg(said, '|' ORDER BY n) AS texts FROM f GROUP BY l_orderkey
""")
def candidate_forms(spark, sf):
    """Candidates that differ in compatibility forms, once each."""
    forms = "array(array('1', '①', '１'), array('ａ', 'A', 'a'), array('ﬁ', 'fi', 'FI'), array('㍍', 'メートル', 'ﾒｰﾄﾙ'))[l_partkey % 4][l_linenumber % 3]"
    rows = _table(spark, sf, "lineitem", "l_orderkey", f"struct(l_linenumber, l_partkey, l_suppkey, concat(array('カ', 'ｶ', ' カ')[l_suppkey % 3], {forms}) as text) as c")
    listed = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.struct(c["text"].alias("text"), F.lit(1.0).alias("confidence"))).alias("candidates"))
    kept = listed.select("l_orderkey", folds.unique_candidates(F.col("candidates")).alias("c"))
    return kept.select("l_orderkey", F.size("c").cast("long").alias("kept"), F.array_join(F.transform("c", lambda c: c["text"]), "|").alias("texts"))


@query("""
WITH d AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT conv_id AS id, list(text ORDER BY turn, text) AS l FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
b AS (SELECT 0 AS pass, id, l, 0.1::DOUBLE AS y FROM d UNION ALL SELECT 1, id, l, 0.55::DOUBLE FROM c)
SELECT pass, id, k - 1 AS nth, md5(l[k]) AS said, round(1 / k, 6) AS confidence, y FROM (SELECT *, unnest(range(1, least(len(l), 10) + 1)) AS k FROM b)
""")
def candidate_union(spark, sf):
    """Candidates of two passes, the second in a region: lines of documents and
    turns of conversations."""
    listed = lambda rows: rows.selectExpr("id", "transform(l, (x, i) -> struct(x as text, 1.0D / (i + 1) as confidence)) as candidates").withColumn("box", g.rect(0.1, 0.1, 0.2, 0.1))
    docs = _table(spark, sf, "documents", "doc_id as id", "split(text, '\\n') as l").where("l is not null")
    turns = _table(spark, sf, "conversations").where("text is not null").groupBy(F.col("conv_id").alias("id")).agg(F.expr("transform(array_sort(collect_list(struct(turn, text))), x -> x.text)").alias("l"))
    first = observations.flattened(observations.recognised(listed(docs)))
    second = observations.flattened(observations.recognised(listed(turns)), g.rect(0, 0.5, 1, 0.5))
    both = observations.concatenated([first, second])
    return both.select("pass", "id", "nth", F.md5("text").alias("said"), F.round("confidence", 6).alias("confidence"), F.round("box.y", 6).alias("y"))


@query("""
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM lineitem WHERE round(l_discount * 10, 2) >= 0.55) WHERE n <= 8
""")
def rectangle_source(spark, sf):
    rows = _table(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_orderkey * 8 + l_linenumber as at", _CONF)
    return observations.rectangles(rows, "l_partkey", "at").select("l_partkey", "l_orderkey", "l_linenumber")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber > 3 AS fallback, CASE WHEN l_linenumber > 3 THEN 0.62 ELSE round(l_discount * 10, 2) END AS score FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY fallback, l_linenumber, l_partkey, l_suppkey) - 1 AS id FROM c)
SELECT l_orderkey, id, CASE WHEN fallback THEN 'fallback' ELSE 'primary' END AS source, l_linenumber,
  id = first_value(id) OVER (PARTITION BY l_orderkey ORDER BY score >= 0.55 DESC, score DESC, id) AND score >= 0.55 AS chosen FROM i
""")
def fallback_ids(spark, sf):
    """Ids over primary and fallback candidates, and the selected one found
    among them again."""
    rows = _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _CONF)
    primary = rows.where("l_linenumber <= 3").withColumnRenamed("confidence", "score")
    second = rows.where("l_linenumber > 3").drop("confidence").withColumn("score", F.lit(0.62))
    every = observations.with_fallback(primary, second, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("valid", F.col("score") >= 0.55)
    best = observations.selected(every, "l_orderkey").select("l_orderkey", "id", F.lit(True).alias("chosen"))
    return every.join(best, ["l_orderkey", "id"], "left").select("l_orderkey", "id", "source", "l_linenumber", F.coalesce("chosen", F.lit(False)).alias("chosen"))


# ---- passes and states ---------------------------------------------------------------


@query("""
WITH p(ordinal, label, enhanced, y, h, least) AS (VALUES (0, 'normalized-full-card', false, NULL, NULL, 0.008), (1, 'enhanced-full-card', true, NULL, NULL, 0.008), (2, 'enhanced-top-band', true, 0.66, 0.34, 0.006),
  (3, 'enhanced-middle-band', true, 0.32, 0.36, 0.006), (4, 'enhanced-bottom-band', true, 0.0, 0.35, 0.006))
SELECT s_suppkey, ordinal, label, enhanced, y::DOUBLE AS y, h::DOUBLE AS h, least::DOUBLE AS least FROM supplier, p
""")
def planned_passes(spark, sf):
    plan = passes.planned(_table(spark, sf, "supplier", "s_suppkey"))
    return plan.select("s_suppkey", "ordinal", "label", "enhanced", F.col("region.y").alias("y"), F.col("region.h").alias("h"), F.col("min_height").alias("least"))


@query("""
WITH g AS (SELECT user_id, count(*) AS n, list(event_type ORDER BY event_id)[1:5] AS top FROM events GROUP BY user_id)
SELECT user_id, 'user-' || user_id || ': ' || n || ' candidates, ' || CASE WHEN user_id % 2 = 0 THEN 'broad' ELSE 'auto' END || ', ' || CASE WHEN user_id % 3 = 0 THEN 'none' ELSE array_to_string(top, ' | ') END AS summary FROM g
""")
def pass_summaries(spark, sf):
    rows = _table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.expr("transform(array_sort(collect_list(struct(event_id, event_type))), x -> x.event_type)").alias("texts"))
    u = F.col("user_id")
    texts = F.when(u % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("texts"))
    return rows.select("user_id", passes.summary(F.concat(F.lit("user-"), u.cast("string")), F.col("n"), u % 2 == 0, texts).alias("summary"))


@query("""
WITH s(k, state, said) AS (VALUES (0, 'idle', 'Start the camera, then capture a frame to crop the card.'), (1, 'requestingPermission', 'Requesting camera access...'), (2, 'running', 'Scanning for a steady card shape...'),
  (3, 'holdingSteady', 'Hold steady while the card comes into focus...'), (4, 'moveFartherAway', 'Move a little farther away so the card text can focus.'), (5, 'moreLightNeeded', 'More light needed to focus the card text.'),
  (6, 'capturing', 'Cropping captured frame...'), (7, 'completed', 'Card crop captured. Scan again to restart the camera.'), (8, 'failed', NULL)),
r(k, reason) AS (VALUES (0, 'tooCloseLikely'), (1, 'tooDark'), (2, 'tooLowContrast'), (3, 'waitingForAutofocus'), (4, 'tooBlurry'), (5, 'focused'))
SELECT event_id, coalesce(said, event_type) AS shown, state IN ('idle', 'completed', 'failed') AS can_start, state IN ('running', 'holdingSteady', 'moveFartherAway', 'moreLightNeeded') AS can_crop,
  CASE WHEN reason = 'tooCloseLikely' THEN 'moveFartherAway' WHEN reason IN ('tooDark', 'tooLowContrast') THEN 'moreLightNeeded' WHEN reason = 'waitingForAutofocus' OR (reason = 'tooBlurry' AND user_id % 2 = 0) THEN 'holdingSteady' ELSE 'running' END AS next_state
FROM events JOIN s ON s.k = event_id % 9 JOIN r ON r.k = event_id % 6
""")
def camera_states(spark, sf):
    names = lambda *x: F.array(*map(F.lit, x))
    pick = lambda of, n: F.get(of, (F.col("event_id") % n).cast("int"))
    rows = _table(spark, sf, "events", "event_id", "user_id", "event_type").withColumn("state", pick(names(*passes.STATES, "failed"), 9))
    reason = pick(names("tooCloseLikely", "tooDark", "tooLowContrast", "waitingForAutofocus", "tooBlurry", "focused"), 6)
    st = F.col("state")
    return rows.select(
        "event_id", passes.status(st, F.col("event_type")).alias("shown"), passes.can_start(st).alias("can_start"), passes.can_crop(st).alias("can_crop"), gate.scanner_state(reason, F.col("user_id") % 2 == 0).alias("next_state")
    )


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 3 END AS n, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' END AS error FROM orders),
f AS (SELECT o_custkey FROM o GROUP BY o_custkey HAVING sum(n) = 0 AND count(error) > 0)
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM f) AS failed, CASE WHEN c_custkey % 3 = 0 THEN 'explicit' ELSE 'plain' END AS used,
  CASE WHEN c_nationkey % 2 = 0 THEN 'N' || c_nationkey END AS name FROM customer
""")
def pass_outcomes(spark, sf):
    """Failed only where nothing was found; retries; captures completed by name."""
    reports = _table(spark, sf, "orders", "o_custkey as c_custkey", "if(o_orderkey % 7 = 0, 0, o_orderkey % 3) as observations", "if(o_orderkey % 7 = 0, 'failed', null) as error")
    failed = passes.failed(reports, "c_custkey").withColumn("failed", F.lit(True))
    rows = _table(spark, sf, "customer", "c_custkey", "c_nationkey").join(failed, "c_custkey", "left")
    names = _table(spark, sf, "nation", "cast(n_nationkey as int) as c_nationkey", "concat('N', n_nationkey) as name").where("c_nationkey % 2 = 0")
    rows = passes.completed(rows, names, "c_nationkey")
    used = passes.with_retry(F.when(F.col("c_custkey") % 3 == 0, "explicit"), F.lit("plain"))
    return rows.select("c_custkey", F.coalesce("failed", F.lit(False)).alias("failed"), used.alias("used"), "name")


@query(_FRAMES_SQL.replace("FROM events)", "FROM events WHERE event_id % 11 <> 0)") + "SELECT session_id, seq, live AND fires AS should_capture, live AND stable_count >= 3 AS is_stable FROM l UNION ALL SELECT user_id % 50, event_id, NULL, NULL FROM events WHERE event_id % 11 = 0")
def gate_errors(spark, sf):
    """Frames that failed leave the gate's state as it is."""
    good, bad = gate.split_errors(_table(spark, sf, "events", *_FRAMES, "if(event_id % 11 = 0, 'crop failed', null) as error"))
    none = F.lit(None).cast("boolean")
    return gate.decisions(good).select("session_id", "seq", "should_capture", "is_stable").unionByName(bad.select("session_id", "seq", none.alias("should_capture"), none.alias("is_stable")))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, epoch_us(ts) / 1e6::DOUBLE + value * 2000 AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS taken, done AS busy FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.t >= f.busy, CASE WHEN e.t >= f.busy THEN e.done ELSE f.busy END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id FROM f WHERE taken
""")
def frames_on_time(spark, sf):
    rows = _table(spark, sf, "events", "user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6D as t", "unix_micros(cast(ts as timestamp)) / 1e6D + value * 2000 as done")
    return gate.on_time(rows, "user_id", "event_id", "t", "done").select("user_id", "event_id")


# ---- look-ups and what is shown --------------------------------------------------------

_MAPPING = {"de": ["de"], "en": ["en"], "fr": ["fr", "es"], "es": ["es"]}


@query("""
WITH m(lang, codes) AS (VALUES ('de', ['de']), ('en', ['en']), ('fr', ['fr', 'es']), ('es', ['es'])),
d AS (SELECT doc_id, d.lang, source, coalesce(codes, []) AS codes FROM documents d LEFT JOIN m USING (lang)),
g AS (SELECT source, list_sort(list_distinct(flatten(list(codes)))) AS codes FROM d GROUP BY source)
SELECT doc_id, array_to_string(d.codes, ',') AS codes, array_to_string(g.codes, ',') AS source_codes, CASE WHEN list_contains(g.codes, 'xx') THEN 'xx' WHEN list_contains(g.codes, 'es') THEN 'es' WHEN list_contains(g.codes, 'en') THEN 'en' END AS preferred
FROM d JOIN g USING (source) WHERE d.lang IN ('de', 'en', 'fr')
""")
def language_codes(spark, sf):
    """Word-list languages of each document and source, and the first preferred."""
    docs = _table(spark, sf, "documents", "doc_id", "lang", "source")
    of = docs.groupBy("source").agg(lexicon.mapped_set(F.collect_list("lang"), _MAPPING).alias("set"))
    rows = keys.in_list(docs, "lang", ["de", "en", "fr"]).join(of, "source")
    preferred = keys.first_available(F.array(F.lit("xx"), F.lit("es"), F.lit("en")), F.col("set"))
    return rows.select("doc_id", F.array_join(lexicon.mapped(F.col("lang"), _MAPPING), ",").alias("codes"), F.array_join("set", ",").alias("source_codes"), preferred.alias("preferred"))


@query("SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey) WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(spark, sf):
    rows = _table(spark, sf, "orders", "o_orderkey", "o_custkey")
    return keys.point(rows, "o_orderkey", rows.agg(F.max("o_orderkey").alias("k")).first()["k"])


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def parent_child(spark, sf):
    parents = _table(spark, sf, "orders", "o_orderkey as id", "o_custkey", "o_orderstatus")
    nested = _table(spark, sf, "lineitem", "l_orderkey as id", "l_linenumber").groupBy("id").agg(F.collect_list(F.struct("l_linenumber")).alias("lines"))
    joined = feed.with_children(parents, feed.children(nested, "lines"))
    return joined.select(F.col("species_id").alias("l_orderkey"), "l_linenumber", "o_custkey", "o_orderstatus")


@query("""
SELECT event_id, printf('%.2f', value) AS shown, printf('%.2f, %.2f, %.2f, %.2f', (event_id % 10) / 10, (event_id % 20) / 20, 0.5, 0.25) AS box, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS at,
  CASE WHEN event_id % 3 = 0 THEN 'API' WHEN event_id % 3 = 1 THEN 'SEED' ELSE 'TEST' END AS mode, CASE WHEN event_id % 4 = 0 THEN '<root>' ELSE event_type || '.' || user_id END AS path FROM events
""")
def shown_values(spark, sf):
    e = F.col("event_id")
    rows = _table(spark, sf, "events")
    box = F.struct((e % 10 / 10).alias("x"), (e % 20 / 20).alias("y"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))
    name = F.when(e % 3 == 0, F.lit(None).cast("string")).when(e % 3 == 1, "seed").otherwise("Test")
    parts = F.when(e % 8 == 0, F.lit(None).cast("array<string>")).when(e % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.col("user_id").cast("string")))
    return rows.select("event_id", t.two_decimals(F.col("value")).alias("shown"), t.rect_text(box).alias("box"), store.iso(F.col("ts").cast("timestamp")).alias("at"), passes.mode(name).alias("mode"), t.issue_path(parts).alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '{\"k\":1,\"a\":[1,\"x\"]}' WHEN event_id % 5 = 2 THEN '{\"token\":\"[Redacted]\"}' ELSE props END AS kept, CASE WHEN event_id % 2 = 0 THEN '<root>|name.' || event_id ELSE '' END AS issues FROM (SELECT event_id, regexp_replace(props, ' ', '', 'g') AS props FROM events)")
def log_contexts(spark, sf):
    e = F.col("event_id")
    rows = _table(spark, sf, "events")
    context = F.when(e % 5 == 0, "not json").when(e % 5 == 1, '{"k": 1, "a": [1, "x", {"n": 2}], "o": {"n": 1}, "b": [{}]}').when(e % 5 == 2, '{"token": "abc"}').otherwise(F.col("props"))
    issues = F.when(e % 2 == 0, F.concat(F.lit('{"validations": [{}, null, {"path": ["name", '), e.cast("string"), F.lit(']}, {"path": [null]}]}'))).otherwise("{}")
    return rows.select("event_id", logs.redacted_record(logs.sanitised(context)).alias("kept"), F.array_join(logs.issue_paths(issues), "|").alias("issues"))


# ---- from pixels to boxes --------------------------------------------------------

_SHADES = {"red": 400, "green": 300, "blue": 100}
_PLANES_SQL = ", ".join(f"(least(250, greatest(0, floor(170 + v * {k}))) + 1) / 255 AS {n[0]}" for n, k in _SHADES.items())
_MASK_SQL = f"""SELECT vec_id, i FROM (
  SELECT *, avg(l) FILTER (WHERE edge) OVER (PARTITION BY vec_id) AS bl, avg(s) FILTER (WHERE edge) OVER (PARTITION BY vec_id) AS bs FROM (
    SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) AS s, i % 8 < 2 OR i % 8 >= 6 OR i // 8 < 2 OR i // 8 >= 6 AS edge FROM (
      SELECT vec_id, i, {_PLANES_SQL} FROM v)))
  WHERE bl > 0.55 AND l < bl - 0.10 AND (s > 0.08 OR l < bl - 0.20) OR s > bs + 0.12 AND abs(l - bl) > 0.04"""


@query(_components_sql(_MASK_SQL) + f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(pixels / 64.0 * 3 + greatest(0, 1 - least(abs(w / h - 63.0 / 88.0) / (63.0 / 88.0), 1)) * 2, 12) DESC, root) AS n FROM c
  WHERE w >= 2 AND h >= 2 AND pixels / 64.0 >= 0.035 * 0.45 AND pixels / 64.0 <= 0.86 AND w / h <= 1.25),
m AS (SELECT vec_id, x / 8.0 AS x, 1 - (y + h) / 8.0 AS y, w / 8.0 AS w, h / 8.0 AS h, w / 8.0 * h / 8.0 AS a, w / h AS r FROM k WHERE n = 1),
f AS (SELECT *, {_score_sql('0.62', '0.75')} AS score FROM m)
SELECT e.vec_id, f.x::DOUBLE AS x, f.y::DOUBLE AS y, f.w::DOUBLE AS w, f.h::DOUBLE AS h, round(score, 6)::DOUBLE AS score, a >= 0.035 AND a <= 0.86 AND r <= 1.18 AND r >= 0.32 AND score >= 0.55 AS accepted
FROM embeddings e LEFT JOIN f ON e.vec_id = f.vec_id
""")
def pixels_to_box(spark, sf):
    """Images of 16 x 16 pixels, one for each vector, analysed at 8 x 8."""
    shade = "cast(least(250, greatest(0, floor(170 + cast(embedding[(i div 32) * 8 + (i % 16) div 2] as double) * {k}))) + 2 * (i % 2) as int)"
    plane = "unhex(array_join(transform(sequence(0, 255), i -> lpad(hex({0}), 2, '0')), '')) as {1}"
    rows = _table(spark, sf, "embeddings", "vec_id", *(plane.format(shade.format(k=k), n) for n, k in _SHADES.items()), "16 as wide", "16 as high")
    found = images.fallback_detections(rows, tuple(_SHADES), "wide", "high", most=8, radius=0, least=2)
    box = [F.col(f"box.{n}").alias(n) for n in "xywh"]
    return found.select("vec_id", *box, F.round("score", 6).alias("score"), (F.size("reasons") == 0).alias("accepted"))
