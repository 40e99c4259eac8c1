"""Statistics and components of pixel grids kept as row-major arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g, scores as s, text as t
from .keys import best_of_each


def luma(red: Column, green: Column, blue: Column, video: bool = False) -> Column:
    """Brightness; focus uses the first weights, detection the second."""
    wr, wg, wb = (0.2126, 0.7152, 0.0722) if video else (0.299, 0.587, 0.114)
    return red * wr + green * wg + blue * wb


def saturation(red: Column, green: Column, blue: Column) -> Column:
    most = F.greatest(red, green, blue)
    return F.when(most > 0, (most - F.least(red, green, blue)) / most).otherwise(0.0)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def mean_and_std(values: Column) -> Column:
    """struct<mean, std>: the population's."""
    # bound by a one-element array, so that the mean isn't computed again for each element
    return F.get(
        F.transform(F.array(F.struct(_mean(values).alias("m"))), lambda x: F.struct(x["m"].alias("mean"), F.sqrt(_mean(F.transform(values, lambda v: (v - x["m"]) * (v - x["m"])))).alias("std"))),
        F.lit(0),
    )


def _inner(values: Column, width: Column, height: Column, of) -> Column:
    """``of(at)`` for every pixel that isn't on the border; null for grids below
    3 x 3 or of another size than said.  ``at(dx, dy)`` is a neighbour."""
    ok = (width >= 3) & (height >= 3) & (F.size(values) == width * height)
    at = lambda i: lambda dx, dy: F.get(values, (F.floor(i / (width - 2)) + 1 + dy).cast("int") * width + (i % (width - 2) + 1 + dx).cast("int"))
    return F.when(ok, F.transform(F.sequence(F.lit(0), F.greatest((width - 2) * (height - 2) - 1, F.lit(0))), lambda i: of(at(i))))


def laplacian_variance(values: Column, width: Column, height: Column) -> Column:
    lap = _inner(values, width, height, lambda p: p(0, -1) + p(-1, 0) + p(1, 0) + p(0, 1) - 4 * p(0, 0))
    std = mean_and_std(lap)["std"]
    return std * std


def tenengrad(values: Column, width: Column, height: Column) -> Column:
    """Mean length of the Sobel gradient."""

    def gradient(p):
        x = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
        y = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
        return F.sqrt(x * x + y * y)

    return _mean(_inner(values, width, height, gradient))


def border_mean(values: Column, width: Column, height: Column) -> Column:
    """Mean over the border, max(2, min(width, height) / 20) pixels wide."""
    edge = F.greatest(F.lit(2), F.floor(F.least(width, height) / 20).cast("int"))
    x, y = lambda i: i % width, lambda i: F.floor(i / width)
    on = lambda i: (x(i) < edge) | (x(i) >= width - edge) | (y(i) < edge) | (y(i) >= height - edge)
    return _mean(F.filter(values, lambda v, i: on(i)))


def _by_pixel(region: Column, width: Column, height: Column) -> Column:
    """struct<x0, y0, w, h: int>: whole pixels of a pixel rectangle, y down,
    within a grid."""

    def within(box: Column) -> Column:
        x0, y0 = F.greatest(box["x"], F.lit(0.0)), F.greatest(box["y"], F.lit(0.0))
        right, bottom = F.least(box["x"] + box["w"], width.cast("double")), F.least(box["y"] + box["h"], height.cast("double"))
        size = lambda a, b: F.greatest(b - a, F.lit(0.0)).cast("int")
        return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), size(x0, right).alias("w"), size(y0, bottom).alias("h"))

    return t.bound(g.integral(region), within)


def cropped(values: Column, width: Column, height: Column, region: Column) -> Column:
    """struct<x0, y0, w, h, values>: the whole pixels that a pixel rectangle
    (y down) touches, row by row; null where it touches none."""

    def cut(at: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.greatest(at["h"], F.lit(1)) - 1), lambda r: F.slice(values, (at["y0"] + r) * width + at["x0"] + 1, at["w"]))
        kept = F.struct(at["x0"].alias("x0"), at["y0"].alias("y0"), at["w"].alias("w"), at["h"].alias("h"), F.flatten(rows).alias("values"))
        return F.when((at["w"] > 0) & (at["h"] > 0), kept)

    return t.bound(_by_pixel(region, width, height), cut)


def region_of_pass(values: Column, width: Column, height: Column, region: Column) -> Column:
    """What a pass sees: the crop of its region (normalised, y up), the whole
    grid where it has none."""
    clipped = g.intersection(g.to_pixels(region, width, height), g.rect(0, 0, width, height))
    whole = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), width.cast("int").alias("w"), height.cast("int").alias("h"), values.alias("values"))
    return F.coalesce(F.when(region.isNotNull(), cropped(values, width, height, clipped)), whole)


# Fixed value: the band of a card in which its title's sharpness is measured (x, y down, w, h).
TITLE_BAND = (0.06, 0.03, 0.88, 0.24)


def title_band(values: Column, width: Column, height: Column) -> Column:
    """The crop of the title band; null where it has fewer than 3 x 3 pixels."""
    x, y, w, h = TITLE_BAND
    return t.bound(cropped(values, width, height, g.rect(width * x, height * y, width * w, height * h)), lambda c: F.when((c["w"] >= 3) & (c["h"] >= 3), c))


def reduced_size(width: Column, height: Column, most: int) -> Column:
    """struct<w, h>: a size scaled down so that both sides are at most ``most``."""
    scale = F.least(most / width, most / height, F.lit(1.0))
    side = lambda v: F.greatest(F.lit(1), F.round(v * scale).cast("int"))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def downsampled(values: Column, width: Column, height: Column, most: int) -> Column:
    """struct<w, h, values>: each pixel of the reduced grid is the mean of the
    pixels it covers."""

    def reduced(s: Column) -> Column:
        def pixel(i: Column) -> Column:
            x, y = i % s["w"], F.floor(i / s["w"]).cast("int")
            x0, y0 = F.floor(x * width / s["w"]).cast("int"), F.floor(y * height / s["h"]).cast("int")
            x1 = F.greatest(F.floor((x + 1) * width / s["w"]).cast("int"), x0 + 1)
            y1 = F.greatest(F.floor((y + 1) * height / s["h"]).cast("int"), y0 + 1)
            return _mean(F.flatten(F.transform(F.sequence(y0, y1 - 1), lambda r: F.slice(values, r * width + x0 + 1, x1 - x0))))

        return F.struct(s["w"].alias("w"), s["h"].alias("h"), F.transform(F.sequence(F.lit(0), s["w"] * s["h"] - 1), pixel).alias("values"))

    return t.bound(reduced_size(width, height, most), reduced)


def crop_foreground(pixel: Column, border: Column) -> Column:
    """Pixels of a card on its background as the crop sees them: brighter,
    darker on a bright ground, of another colour there, or colourful.  Both are
    struct<r, g, b, luma, saturation>."""
    brighter = pixel["luma"] > border["luma"] + 0.16
    bright = border["luma"] > 0.55
    darker = bright & (pixel["luma"] < border["luma"] - 0.12)
    differs = (F.abs(pixel["r"] - border["r"]) + F.abs(pixel["g"] - border["g"]) + F.abs(pixel["b"] - border["b"])) / 3
    colourful = (pixel["saturation"] > F.greatest(F.lit(0.18), border["saturation"] + 0.14)) & (brighter | darker | (differs > 0.08))
    return brighter | darker | (bright & (differs > 0.14)) | colourful


def detected_components(found: DataFrame, image: Column) -> DataFrame:
    """Components (w, h, pixels) that may be a card when nothing else was detected."""
    share = F.col("pixels") / image
    return found.where((F.col("w") >= 10) & (F.col("h") >= 10) & (share >= s.MIN_AREA * 0.45) & (share <= s.MAX_AREA) & (F.col("w") / F.col("h") <= 1.25))


def crop_components(found: DataFrame, image: Column) -> DataFrame:
    """Components (w, h, pixels) that may be a card in a crop."""
    share = F.col("pixels") / image
    return found.where((F.col("w") >= 8) & (F.col("h") >= 8) & (share >= 0.004) & (share <= 0.85))


def best_component(found: DataFrame, key: str, score: str) -> DataFrame:
    """The component of the highest score of each grid, the first found of equals."""
    return best_of_each(found, [key], score, F.asc("component"))


def foreground(luminance: Column, sat: Column, border_luminance: Column, border_sat: Column) -> Column:
    """Pixels of a card on its background, by brightness and colour."""
    darker = (border_luminance > 0.55) & (luminance < border_luminance - 0.10) & ((sat > 0.08) | (luminance < border_luminance - 0.20))
    return darker | ((sat > border_sat + 0.12) & (F.abs(luminance - border_luminance) > 0.04))


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    """Set pixels grown to squares of the given radius."""
    for axis in (0, 1):
        grown = mask.copy()
        for d in range(1, radius + 1):
            ahead = [slice(None)] * 2
            back = [slice(None)] * 2
            ahead[axis], back[axis] = slice(d, None), slice(None, -d)
            grown[tuple(ahead)] |= mask[tuple(back)]
            grown[tuple(back)] |= mask[tuple(ahead)]
        mask = grown
    return mask


def labelled(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """4-connected components as (x, y, w, h, pixels), in the order of their
    first pixel, row by row: a union of row runs that touch, in two passes."""
    if not mask.size:
        return []
    width = mask.shape[1] + 1  # a blank column keeps the runs of two rows apart
    flat = np.zeros((mask.shape[0], width), np.int8)
    flat[:, :-1] = mask
    turns = np.diff(flat.ravel(), prepend=0)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    # of each run, the runs of the row above that share a column: they follow each other
    first, last = np.searchsorted(ends, starts - width, "right"), np.searchsorted(starts, ends - width, "left")
    parent = list(range(len(starts)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k, (low, high) in enumerate(zip(first.tolist(), last.tolist())):
        for above in range(low, high):
            one, other = root(k), root(above)
            parent[max(one, other)] = min(one, other)
    of = np.unique([root(k) for k in range(len(starts))], return_inverse=True)[1]
    order = np.argsort(of, kind="stable")
    at = np.flatnonzero(np.diff(of[order], prepend=-1))
    if not len(at):
        return []
    left, row, right = (starts % width)[order], (starts // width)[order], (ends - 1)[order] % width
    x, y = np.minimum.reduceat(left, at), np.minimum.reduceat(row, at)
    w, h = np.maximum.reduceat(right, at) - x + 1, np.maximum.reduceat(row, at) - y + 1
    return list(zip(*(v.tolist() for v in (x, y, w, h, np.add.reduceat((ends - starts)[order], at)))))


def components(df: DataFrame, key: str, mask_col: str, width_col: str, height_col: str, radius: int = 0) -> DataFrame:
    """Rows (key, component, x, y, w, h, pixels) of every grid's mask."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for k, m, w, h in zip(b["k"], b["m"], b["w"], b["h"]):
                grid = np.asarray(m, bool).reshape(int(h), int(w))
                rows += [(k, i, *c) for i, c in enumerate(labelled(dilated(grid, radius) if radius else grid))]
            yield pd.DataFrame(rows, columns=["k", "component", "x", "y", "w", "h", "pixels"])

    cut = df.select(F.col(key).alias("k"), F.col(mask_col).alias("m"), F.col(width_col).alias("w"), F.col(height_col).alias("h"))
    return cut.mapInPandas(run, f"k {kind}, component int, x int, y int, w int, h int, pixels int").withColumnRenamed("k", key)
