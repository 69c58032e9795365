"""Box geometry as Catalyst expressions. A box is a struct column with x, y, w, h and its origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def model_scale(size: Column, side: int = 640) -> Column:
    """Factor from the model's square to an image; 1 where the image has no size."""
    return F.coalesce(F.nullif(size, F.lit(0)), F.lit(side)) / side


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    """Model space to image space."""
    return box(b["x"] * sx, b["y"] * sy, b["w"] * sx, b["h"] * sy)


def to_pdf(b: Column, img_w: Column, img_h: Column, pdf_w: Column, pdf_h: Column) -> Column:
    """Image pixels to points with the origin at the bottom left."""
    sx, sy = pdf_w / img_w, pdf_h / img_h
    return box(b["x"] * sx, pdf_h - (b["y"] + b["h"]) * sy, b["w"] * sx, b["h"] * sy)


def letterbox(w: Column, h: Column, side: int = 640) -> dict[str, Column]:
    """Scale, scaled size and padding that fit an image into a square."""
    scale = F.least(side / w, side / h)
    sw, sh = (w * scale).cast("int"), (h * scale).cast("int")
    return {"scale": scale, "scaled_w": sw, "scaled_h": sh, "pad_x": (side - sw) / 2, "pad_y": (side - sh) / 2}


def crop(b: Column, w: Column, h: Column) -> dict[str, Column]:
    """Pixel rectangle of a box inside an image; empty when nothing remains."""
    x, y = F.greatest(b["x"].cast("int"), F.lit(0)), F.greatest(b["y"].cast("int"), F.lit(0))
    return {"crop_x": x, "crop_y": y, "crop_w": F.least(b["w"].cast("int"), w - x), "crop_h": F.least(b["h"].cast("int"), h - y)}


def moved(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x"] + dx, b["y"] + dy, b["w"], b["h"])


def union_agg(b: Column) -> Column:
    """Aggregate: the smallest box around all."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return box(x, y, F.max(b["x"] + b["w"]) - x, F.max(b["y"] + b["h"]) - y)


def gap_distance(a: Column, b: Column) -> Column:
    """Distance between the nearest edges; zero when the boxes meet."""
    dx = F.greatest(F.lit(0.0), a["x"] - (b["x"] + b["w"]), b["x"] - (a["x"] + a["w"]))
    dy = F.greatest(F.lit(0.0), a["y"] - (b["y"] + b["h"]), b["y"] - (a["y"] + a["h"]))
    return F.sqrt(dx * dx + dy * dy)


def angle(a: Column, b: Column) -> Column:
    """Absolute angle between centres in degrees."""
    dx = (b["x"] + b["w"] / 2) - (a["x"] + a["w"] / 2)
    dy = (b["y"] + b["h"] / 2) - (a["y"] + a["h"] / 2)
    return F.abs(F.degrees(F.atan2(dy, dx)))


def is_horizontal(angle_: Column) -> Column:
    return (angle_ <= 40) | (angle_ >= 140)


def overlaps_x(a: Column, b: Column) -> Column:
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    u = a["w"] * a["h"] + b["w"] * b["h"] - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def overlap_fraction(region: Column, block: Column) -> Column:
    """Share of the block's area inside the region."""
    area = block["w"] * block["h"]
    return F.when(area > 0, intersection(region, block) / area).otherwise(F.lit(0.0))


def overlap_x_fraction(a: Column, b: Column) -> Column:
    """Horizontal overlap as a share of the narrower width."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    narrow = F.least(a["w"], b["w"])
    return F.when(narrow > 0, F.greatest(w, F.lit(0.0)) / narrow).otherwise(F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    return (inner["x"] >= outer["x"]) & (inner["y"] >= outer["y"]) & (inner["x"] + inner["w"] <= outer["x"] + outer["w"]) & (inner["y"] + inner["h"] <= outer["y"] + outer["h"])


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
