"""The fallback detection, from the colour planes of an image to a box."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as g, scores as s
from .grids import dilated, labelled, luma

# Longest side of the analysed image, growth of its mask, least
# side of a component there, and what a fallback is trusted with.
MOST, RADIUS, LEAST, CONFIDENCE, CONTENT = 260, 4, 10, 0.62, 0.75

PART = "struct<component: int, x: int, y: int, w: int, h: int, pixels: int>"


def _sized(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of the pixels that each pixel of a smaller plane covers."""
    height, width = plane.shape
    if (height, width) == (h, w):
        return plane
    y, x = np.arange(h) * height // h, np.arange(w) * width // w
    sums = np.add.reduceat(np.add.reduceat(plane, y, axis=0), x, axis=1)
    return sums / np.outer(np.diff(y, append=height), np.diff(x, append=width))


def _saturation(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    most = np.maximum(np.maximum(red, green), blue)
    least = np.minimum(np.minimum(red, green), blue)
    return np.divide(most - least, most, out=np.zeros_like(most), where=most > 0)


def shape_mask(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    """Pixels that differ from the mean of the border as a card does from a
    table; the planes hold 0 to 1."""
    light, colour = luma(red, green, blue, video=True), _saturation(red, green, blue)
    edge = max(2, min(light.shape) // 20)
    border = np.ones(light.shape, bool)
    border[edge:-edge, edge:-edge] = False
    ground, tint = light[border].mean(), colour[border].mean()
    darker = (ground > 0.55) & (light < ground - 0.10) & ((colour > 0.08) | (light < ground - 0.20))
    return darker | ((colour > tint + 0.12) & (np.abs(light - ground) > 0.04))


def _analysed(planes: list[bytes | None], width: int | None, height: int | None, most: int, radius: int) -> tuple[int, int, list]:
    """The analysed size and its components; none for planes that are missing
    or of another size than said."""
    if not width or not height or width < 0 or any(p is None or len(p) != width * height for p in planes):
        return 1, 1, []
    scale = min(most / width, most / height, 1.0)
    w, h = (max(1, int(side * scale + 0.5)) for side in (width, height))
    channels = [_sized(np.frombuffer(p, np.uint8).reshape(height, width).astype(float), h, w) / 255 for p in planes]
    mask = shape_mask(*channels)
    return w, h, labelled(dilated(mask, radius) if radius else mask)


def card_components(df: DataFrame, planes: tuple[str, str, str], width: str, height: str, most: int = MOST, radius: int = RADIUS) -> DataFrame:
    """``df`` with ``analysed``: struct<w, h, parts>, the size of the reduced
    image and the components of its mask, row by row.

    The planes are binary columns of a byte a pixel, row-major from the top;
    they are viewed where Arrow keeps them.  An image without planes, without a
    size, or whose planes have another length has no components.  Other columns
    pass through, so nothing is shuffled; a column ``analysed`` is replaced."""
    df = df.drop("analysed")
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"analysed struct<w: int, h: int, parts: array<{PART}>>")])
    names = [f.name for f in schema]

    def run(batches):
        kind = pa.struct([("w", pa.int32()), ("h", pa.int32()), ("parts", pa.list_(pa.struct([(n, pa.int32()) for n in ("component", "x", "y", "w", "h", "pixels")])))])
        for batch in batches:
            bands = [batch.column(p) for p in planes]
            found = []
            for k, (wide, high) in enumerate(zip(batch.column(width).to_pylist(), batch.column(height).to_pylist())):
                views = [memoryview(b[k].as_buffer()) if b[k].is_valid else None for b in bands]
                w, h, parts = _analysed(views, wide, high, most, radius)
                found.append({"w": w, "h": h, "parts": [dict(zip(("component", "x", "y", "w", "h", "pixels"), (i, *c))) for i, c in enumerate(parts)]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names)

    return df.mapInArrow(run, schema)


def best_part(analysed: Column, least: int = LEAST) -> Column:
    """The component that looks most like a card, the first of equals; null
    where none may be one."""
    image = analysed["w"] * analysed["h"]

    def may_be(c: Column) -> Column:
        share = c["pixels"] / image
        return (c["w"] >= least) & (c["h"] >= least) & (share >= s.MIN_AREA * 0.45) & (share <= s.MAX_AREA) & (c["w"] / c["h"] <= 1.25)

    ranked = F.transform(
        F.filter(analysed["parts"], may_be),
        lambda c: F.struct(s.component_score(c["w"], c["h"], c["pixels"], image).alias("score"), (-c["component"]).alias("back"), c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h")),
    )
    return F.array_max(ranked)


def fallback_detections(df: DataFrame, planes: tuple[str, str, str], width: str, height: str, most: int = MOST, radius: int = RADIUS, least: int = LEAST) -> DataFrame:
    """``df`` with ``box`` (normalised, y up; null where nothing was found),
    ``score`` and ``reasons`` of rejection (empty where it is accepted); columns
    of these names are replaced."""
    found = card_components(df, planes, width, height, most, radius)
    found = found.drop("box", "score", "reasons").withColumn("__best", best_part(F.col("analysed"), least))
    b, a = F.col("__best"), F.col("analysed")
    box = g.rect(b["x"] / a["w"], 1 - (b["y"] + b["h"]) / a["h"], b["w"] / a["w"], b["h"] / a["h"])
    found = found.withColumn("box", F.when(b.isNotNull(), box)).drop("__best", "analysed")
    aspect = F.col(width) / F.col(height)
    return found.withColumn("__d", F.when(F.col("box").isNotNull(), s.detection(F.col("box"), F.lit(CONFIDENCE), None, aspect, F.lit(CONTENT)))).select(
        "*", F.col("__d.score").alias("score"), F.col("__d.reasons").alias("reasons")
    ).drop("__d")
