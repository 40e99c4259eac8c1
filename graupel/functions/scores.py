"""Scores and classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import geometry as g, text as t

# Thresholds of the detection score and of focus.
MIN_CONFIDENCE, MIN_AREA, MAX_AREA, MIN_SCORE = 0.55, 0.035, 0.86, 0.55
MIN_ASPECT, MAX_ASPECT = 0.45, 1.05
BRIGHTNESS, CONTRAST, SHARPNESS, GRADIENT, CLOSE = 35.0, 18.0, 120.0, 18.0, 0.68


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def area_score(a: Column) -> Column:
    return F.when(a <= 0, 0.0).when(a < 0.10, unit(a / 0.10)).when(a <= 0.45, 1.0).otherwise(unit(1 - (a - 0.45) / 0.41))


def aspect_score(r: Column) -> Column:
    widest = max(g.CARD_ASPECT - MIN_ASPECT, MAX_ASPECT - g.CARD_ASPECT)
    return (
        F.when(r <= 0, 0.0).when(r < MIN_ASPECT, unit(r / MIN_ASPECT)).when(r > MAX_ASPECT, unit(1 - (r - MAX_ASPECT) / 0.20))
        .otherwise(unit(1 - F.abs(r - g.CARD_ASPECT) / widest * 0.45))
    )


def _tenth(shape: Column) -> Column:
    """A tenth of a shape's score as the double next to it (0.035, where 0.35 * 0.10 is a digit less)."""
    return shape * 10 / 100


def _side(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)  # each step rounded as IEEE says; hypot's last digit is the platform's


def side_aspect(corners: Column, image_aspect: Column) -> Column:
    """Mean width by mean height of four corners (tl, tr, br, bl of x, y)."""

    def ratio(c: Column) -> Column:
        w = (_side(c["tl"], c["tr"]) + _side(c["bl"], c["br"])) / 2 * image_aspect
        return t.bound((_side(c["tl"], c["bl"]) + _side(c["tr"], c["br"])) / 2, lambda h: F.when(h > 0, w / h).otherwise(0.0))

    return t.bound(corners, ratio)


def is_convex(corners: Column) -> Column:
    """All turns, but for nearly straight ones, go the same way."""

    def turn(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    def turns(c: Column) -> Column:
        p = [c[n] for n in ("tl", "tr", "br", "bl")]
        return F.array(*(turn(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) for i in range(4)))

    return ~t.bound(t.bound(corners, turns), lambda x: F.exists(x, lambda v: v > 0.0001) & F.exists(x, lambda v: v < -0.0001))


def shape_score(corners: Column | None) -> Column:
    if corners is None:
        return F.lit(0.6)

    def scored(c: Column) -> Column:
        span = lambda n: F.greatest(*(c[k][n] for k in ("tl", "tr", "br", "bl"))) - F.least(*(c[k][n] for k in ("tl", "tr", "br", "bl")))
        odd = t.bound(side_aspect(c, F.lit(1.0)), lambda ratio: F.when((ratio > 0.28) & (ratio < 1.22), 1.0).otherwise(0.35))
        return F.when(c.isNull(), 0.6).when(~is_convex(c) | (span("x") <= 0) | (span("y") <= 0), 0.1).otherwise(odd)

    return t.bound(corners, scored)


def detection(box: Column, confidence: Column, corners: Column | None = None, image_aspect: Column | None = None, content: Column | None = None) -> Column:
    """struct<score, reasons>: a detection's score, and why it is rejected (an
    empty array where it is accepted)."""
    aspect = F.lit(1.0) if image_aspect is None else image_aspect
    bounding = F.when(box["h"] > 0, box["w"] * aspect / box["h"]).otherwise(0.0)
    ratio = bounding if corners is None else F.coalesce(F.when(corners.isNotNull(), side_aspect(corners, aspect)), bounding)
    parts = F.struct((box["w"] * box["h"]).alias("area"), bounding.alias("bounding"), ratio.alias("ratio"), shape_score(corners).alias("shape"))
    given, held = unit(confidence.cast("double")) * 0.30, unit(F.lit(0.5) if content is None else content) * 0.20
    outside = (box["w"] <= 0) | (box["h"] <= 0) | (box["x"] < 0) | (box["y"] < 0) | (box["x"] + box["w"] > 1) | (box["y"] + box["h"] > 1)

    def scored(p: Column) -> Column:
        return given + area_score(p["area"]) * 0.20 + aspect_score(p["ratio"]) * 0.20 + held + _tenth(p["shape"])

    def judged(p: Column) -> Column:
        rules = [
            ("lowConfidence", confidence < MIN_CONFIDENCE), ("invalidBounds", outside), ("tooSmall", p["area"] < MIN_AREA), ("tooLarge", p["area"] > MAX_AREA),
            ("unlikelyOrientation", (p["bounding"] > 1.25) | (p["ratio"] < 0.32) | (p["ratio"] > 1.18)), ("poorScore", p["score"] < MIN_SCORE),
        ]
        reasons = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
        return F.struct(p["score"].alias("score"), reasons.alias("reasons"))

    return t.bound(t.bound(parts, lambda p: F.struct(p["area"].alias("area"), p["bounding"].alias("bounding"), p["ratio"].alias("ratio"), scored(p).alias("score"))), judged)


def with_detection(df: DataFrame, name: str, box: str, confidence: Column, corners: str, image_aspect: Column, content: Column | None = None) -> DataFrame:
    """``df`` with ``name``: struct<convex, ratio, shape, score, reasons>, what
    ``detection`` gives for boxes with corners, step by step.  Each step is a
    projection of its own, whose values the next one reads as plain columns, so
    all is compiled; a value within ``detection`` is bound by an array function,
    which isn't.  Columns that begin with ``__d_`` are replaced and dropped."""
    c, b = {n: F.col(corners)[n] for n in ("tl", "tr", "br", "bl")}, F.col(box)
    p = list(c.values())
    turns = [f"__d_t{i}" for i in range(4)]
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
    span = lambda n: F.greatest(*(k[n] for k in p)) - F.least(*(k[n] for k in p))
    kept = df.columns
    df = df.withColumns(
        {t: turn(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) for i, t in enumerate(turns)}
        | {
            "__d_w": (_side(c["tl"], c["tr"]) + _side(c["bl"], c["br"])) / 2, "__d_h": (_side(c["tl"], c["bl"]) + _side(c["tr"], c["br"])) / 2, "__d_sx": span("x"), "__d_sy": span("y"),
            "__d_area": b["w"] * b["h"], "__d_bounding": F.when(b["h"] > 0, b["w"] * image_aspect / b["h"]).otherwise(0.0), "__d_conf": confidence.cast("double"),
        }
    )
    v = lambda n: F.col(f"__d_{n}")
    sides = lambda aspect: F.when(v("h") > 0, v("w") * aspect / v("h")).otherwise(0.0)
    df = df.withColumns({"__d_convex": ~((F.greatest(*turns) > 0.0001) & (F.least(*turns) < -0.0001)), "__d_plain": sides(F.lit(1.0)), "__d_sides": sides(image_aspect)})
    there = F.col(corners).isNotNull()
    odd = F.when(v("plain").between(0.28, 1.22) & ~v("plain").isin(0.28, 1.22), 1.0).otherwise(0.35)
    df = df.withColumns({
        "__d_shape": F.when(~there, 0.6).when(~v("convex") | (v("sx") <= 0) | (v("sy") <= 0), 0.1).otherwise(odd), "__d_ratio": F.when(there & v("sides").isNotNull(), v("sides")).otherwise(v("bounding")),
    })
    held = unit(F.lit(0.5) if content is None else content)
    df = df.withColumn("__d_score", unit(v("conf")) * 0.30 + area_score(v("area")) * 0.20 + aspect_score(v("ratio")) * 0.20 + held * 0.20 + _tenth(v("shape")))
    outside = (b["w"] <= 0) | (b["h"] <= 0) | (b["x"] < 0) | (b["y"] < 0) | (b["x"] + b["w"] > 1) | (b["y"] + b["h"] > 1)
    rules = [
        ("lowConfidence", v("conf") < MIN_CONFIDENCE), ("invalidBounds", outside), ("tooSmall", v("area") < MIN_AREA), ("tooLarge", v("area") > MAX_AREA),
        ("unlikelyOrientation", (v("bounding") > 1.25) | (v("ratio") < 0.32) | (v("ratio") > 1.18)), ("poorScore", v("score") < MIN_SCORE),
    ]
    df = df.withColumn("__d_why", F.concat_ws(",", *(F.when(rule, reason) for reason, rule in rules)))
    reasons = F.when(v("why") == "", F.array().cast("array<string>")).otherwise(F.split("__d_why", ","))
    made = F.struct(*(v(n).alias(n) for n in ("convex", "ratio", "shape", "score")), reasons.alias("reasons"))
    return df.select(*(F.col(f"`{k}`") for k in kept if k != name), made.alias(name))


def title_score(text: Column, confidence: Column, box: Column, region: Column | None = None) -> Column:
    """How likely a recognised line is the title; null where it can't be."""
    placed = F.lit(0.0)
    if region is not None:
        own = g.area(box)
        share = F.when(own > 0, g.overlap(region, box) / own).otherwise(0.0)
        placed = (
            F.when(share >= 0.8, 120.0).when(share >= 0.35, 60.0).otherwise(-90.0) - F.when(box["y"] < region["y"], 20.0).otherwise(0.0)
            - F.when(box["x"] + box["w"] / 2 < region["x"], 100.0).when(box["x"] < region["x"], 50.0).otherwise(0.0)
            - F.when(box["w"] < 0.08, 20.0).otherwise(0.0)
        )
        placed = F.when(region.isNull(), 0.0).otherwise(placed)

    def scored(x: Column) -> Column:
        n = x["n"]
        return F.when(
            x["script"] | x["latin"],
            confidence.cast("double") * 100 + F.when(x["script"], 80.0).otherwise(0.0) + F.when(x["latin"], 45.0).otherwise(0.0)
            + F.when(x["suffix"], 20.0).otherwise(0.0) + F.when(n.between(2, 18), 15.0).otherwise(-F.abs(n - 10).cast("double"))
            - F.when(x["digits"] > 0, 35.0).otherwise(0.0) - F.when(t.share_of_digits(x["digits"], n) >= 0.5, 80.0).otherwise(0.0) + placed,
        )

    seen = F.struct(
        t.has_script(text).alias("script"), t.has_latin(text).alias("latin"), t.has_suffix(text).alias("suffix"), t.graphemes(text).alias("n"), F.regexp_count(text, F.lit(r"\p{Nd}")).alias("digits")
    )
    return F.when((text != "") & ~t.is_junk(text), t.bound(seen, scored))


def focus_reason(sharpness: Column, gradient: Column, brightness: Column, contrast: Column, area: Column, adjusting: Column) -> Column:
    """Why a frame isn't in focus, the first rule that holds."""
    soft = (sharpness < SHARPNESS) | (gradient < GRADIENT)
    return (
        F.when(adjusting, "waitingForAutofocus").when(brightness < BRIGHTNESS, "tooDark").when(contrast < CONTRAST, "tooLowContrast")
        .when((area >= CLOSE) & soft, "tooCloseLikely").when(soft, "tooBlurry").otherwise("focused")
    )


def component_score(w: Column, h: Column, pixels: Column, image: Column) -> Column:
    """A fallback component: its share of the image and its shape."""
    return pixels / image * 3 + F.greatest(F.lit(0.0), 1 - F.least(F.abs(w / h - g.CARD_ASPECT) / g.CARD_ASPECT, F.lit(1.0))) * 2


def crop_component_score(box: Column, pixels: Column, width: Column, height: Column) -> Column:
    """A crop component: share, fill, shape and place."""
    shape = F.greatest(F.lit(0.0), 1 - F.least(F.abs(box["w"] / box["h"] - g.CARD_ASPECT), F.lit(1.0)))
    low = F.when((box["y"] + box["h"] / 2) / height > 0.18, 1.0).otherwise(0.6)
    return pixels / (width * height) * 3 + pixels / F.greatest(box["w"] * box["h"], F.lit(1.0)) + shape + low
