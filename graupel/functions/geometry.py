"""Rectangles as struct<x, y, w, h: double> columns, in column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bound

# Fixed value: the target shape of a card, width by height.
CARD_ASPECT = 63.0 / 88.0


def rect(x, y, w, h) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.named_struct(*(c for v, n in zip((x, y, w, h), "xywh") for c in (F.lit(n), as_col(v).cast("double"))))


def area(r: Column) -> Column:
    return F.when((r["w"] > 0) & (r["h"] > 0), r["w"] * r["h"]).otherwise(0.0)


def mid(r: Column) -> tuple[Column, Column]:
    return r["x"] + r["w"] / 2, r["y"] + r["h"] / 2


def overlap(a: Column, b: Column) -> Column:
    """Area that two rectangles share; 0 where they are apart."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where disjoint or where the union is empty."""
    common = overlap(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common / union).otherwise(0.0)


def intersection(a: Column, b: Column) -> Column:
    """The shared rectangle, null where the two are apart."""

    def shared(p: Column) -> Column:
        a, b = p["a"], p["b"]
        x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
        return rect(x, y, F.least(a["x"] + a["w"], b["x"] + b["w"]) - x, F.least(a["y"] + a["h"], b["y"] + b["h"]) - y)

    there = lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), shared(p))
    return bound(bound(F.struct(a.alias("a"), b.alias("b")), there), lambda r: F.when((r["w"] >= 0) & (r["h"] >= 0), r))


def inset(box: Column, dx: float, dy: float) -> Column:
    return bound(box, lambda r: rect(r["x"] + dx, r["y"] + dy, r["w"] - 2 * dx, r["h"] - 2 * dy))


def from_region(box: Column, region: Column) -> Column:
    """A box relative to a region, in the frame of the region."""
    return rect(region["x"] + box["x"] * region["w"], region["y"] + box["y"] * region["h"], box["w"] * region["w"], box["h"] * region["h"])


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """Normalised, y up, to pixels, y down."""
    return rect(box["x"] * width, (1 - (box["y"] + box["h"])) * height, box["w"] * width, box["h"] * height)


def to_normalised(box: Column, width: Column, height: Column) -> Column:
    """Pixels, y down, to normalised, y up, clipped to the image."""
    x, y = F.greatest(box["x"], F.lit(0.0)), F.greatest(box["y"], F.lit(0.0))
    right, bottom = F.least(box["x"] + box["w"], width), F.least(box["y"] + box["h"], height)
    ok = (width > 0) & (height > 0) & (right >= x) & (bottom >= y)
    return F.when(ok, rect(x / width, 1 - bottom / height, (right - x) / width, (bottom - y) / height)).otherwise(rect(0, 0, 0, 0))


def crop_projection(box: Column, width: Column, height: Column, buffer: float = 0.08) -> Column:
    """struct<rect, clipped>: the box grown to the card's shape about its
    centre, with a buffer on each side, clipped to the image."""

    def grown(b: Column) -> Column:
        wide = b["w"] / b["h"] > CARD_ASPECT
        w = F.when(wide, b["w"]).otherwise(b["h"] * CARD_ASPECT) * (1 + 2 * buffer)
        h = F.when(wide, b["w"] / CARD_ASPECT).otherwise(b["h"]) * (1 + 2 * buffer)
        cx, cy = mid(b)
        return bound(F.struct(w.alias("w"), h.alias("h")), lambda s: rect(cx - s["w"] / 2, cy - s["h"] / 2, s["w"], s["h"]))

    def clipped(p: Column) -> Column:
        x, y = F.greatest(p["x"], F.lit(0.0)), F.greatest(p["y"], F.lit(0.0))
        kept = rect(x, y, F.least(p["x"] + p["w"], width) - x, F.least(p["y"] + p["h"], height) - y)
        cut = (p["x"] < 0) | (p["y"] < 0) | (p["x"] + p["w"] > width) | (p["y"] + p["h"] > height)
        return F.struct(kept.alias("rect"), cut.alias("clipped"))

    none = F.struct(rect(0, 0, 0, 0).alias("rect"), F.lit(False).alias("clipped"))
    return bound(box, lambda b: F.when((width > 0) & (height > 0) & (b["w"] > 0) & (b["h"] > 0), bound(grown(b), clipped)).otherwise(none))


def aspect_scaled(box: Column, image_w: Column, image_h: Column, view_w: Column, view_h: Column, fill: bool) -> Column:
    """A normalised, y-up box on a view that shows the image centred, scaled to
    fit into the view or to fill it."""
    pick = F.greatest if fill else F.least
    scale = pick(view_w / image_w, view_h / image_h)
    dx, dy = (view_w - image_w * scale) / 2, (view_h - image_h * scale) / 2
    px = to_pixels(box, image_w * scale, image_h * scale)
    return bound(px, lambda p: rect(p["x"] + dx, p["y"] + dy, p["w"], p["h"]))


def focus_point(box: Column) -> Column:
    """struct<x, y>: the box's centre with swapped axes, the second mirrored,
    both within [0, 1]."""
    cx, cy = mid(box)
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.struct(unit(1 - cy).alias("x"), unit(1 - cx).alias("y"))


def focused_region(box: Column, title: Column) -> Column:
    """The box with a margin, within the title region with its margin and the
    frame; the box with its margin alone where that is empty."""
    allowed = intersection(rect(0, 0, 1, 1), inset(title, -0.06, -0.04))

    def within(wide: Column) -> Column:
        return bound(intersection(allowed, wide), lambda both: F.when(both.isNull() | (both["w"] <= 0) | (both["h"] <= 0), wide).otherwise(both))

    return bound(inset(box, -0.03, -0.025), within)


def stable(now: Column, before: Column) -> Column:
    """Whether a box has hardly moved or changed since the one before."""
    (ax, ay), (bx, by) = mid(now), mid(before)
    a, b = now["w"] * now["h"], before["w"] * before["h"]
    larger = F.greatest(a, b)
    drift = F.when(larger > 0, F.abs(a - b) / larger).otherwise(1.0)
    return (F.hypot(ax - bx, ay - by) <= 0.06) & (iou(now, before) >= 0.65) & (drift <= 0.25)


# The title's share of a card (x and y from the top left), and the margin of the search for it.
TITLE = (0.20, 0.02, 0.55, 0.11)
SEARCH = (0.10, 0.07)


def title_rect(width: Column, height: Column) -> Column:
    """The title's place on an image, in pixels, y down."""
    x, y, w, h = TITLE
    return intersection(rect(width * x, height * y, width * w, height * h), rect(0, 0, width, height))


def observation_region(box: Column, width: Column, height: Column) -> Column:
    """A pixel rectangle, y down, as a normalised one, y up; zero for an image
    without an area."""
    region = lambda b: rect(b["x"] / width, 1 - (b["y"] + b["h"]) / height, b["w"] / width, b["h"] / height)
    return F.when((width > 0) & (height > 0), bound(box, region)).otherwise(rect(0, 0, 0, 0))


def title_region(width: Column, height: Column) -> Column:
    """The title's place, normalised, y up."""
    return observation_region(title_rect(width, height), width, height)


def search_region(width: Column, height: Column) -> Column:
    """The title region with a margin, within the frame."""
    return intersection(rect(0, 0, 1, 1), inset(title_region(width, height), -SEARCH[0], -SEARCH[1]))


def integral(box: Column) -> Column:
    """The least rectangle with whole numbers around a rectangle."""

    def grown(b: Column) -> Column:
        x, y = F.floor(b["x"]), F.floor(b["y"])
        return rect(x, y, F.ceil(b["x"] + b["w"]) - x, F.ceil(b["y"] + b["h"]) - y)

    return bound(box, grown)
