"""Layout detections: decoding, filters, suppression of overlapping boxes, assignment of blocks to regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schema import LABELS, PAGE_KEY, CascadeOptions, LayoutOptions


def class_label(idx: Column, unknown: Column | None = None) -> Column:
    """Label of a class index; ``Class_n`` (or ``unknown``) when there is none."""
    names = F.array(*[F.lit(x) for x in LABELS])
    return F.coalesce(F.when(idx >= 0, F.get(names, idx)), unknown if unknown is not None else F.concat(F.lit("Class_"), idx.cast("string")))


def is_table(label: Column) -> Column:
    return F.coalesce(F.lower(label) == "table", F.lit(False))


def keep_aspect(b: Column, max_ratio: float) -> Column:
    """Narrow columns leave; a limit of 0 or a box without width keeps all."""
    return F.lit(True) if max_ratio <= 0 else (b["w"] <= 0) | (b["h"] / F.nullif(b["w"], F.lit(0.0)) < max_ratio)


def usable(det: DataFrame, o: LayoutOptions = LayoutOptions()) -> DataFrame:
    """Detections over the confidence limit with an area; tables pass the aspect test unseen."""
    ok = (F.col("confidence") >= o.min_confidence) & (F.col("box.w") > 0) & (F.col("box.h") > 0)
    return det.where(ok & (is_table(F.col("label")) | F.coalesce(keep_aspect(F.col("box"), o.max_aspect), F.lit(True))))


def decode_anchors(anchors: DataFrame, o: LayoutOptions = LayoutOptions()) -> DataFrame:
    """Rows (page key, anchor, cx, cy, w, h, scores, scale, pad_x, pad_y, img_w, img_h) to detections in image space.

    The best class wins (first on ties), corners are clamped to the model square, the letterbox is undone, and the box is
    clamped to the image; empty boxes and weak ones leave.
    """
    c = F.col
    top = F.array_max("scores")
    x0, y0 = G.clamp(c("cx") - c("w") / 2, 0.0, o.side), G.clamp(c("cy") - c("h") / 2, 0.0, o.side)
    x1, y1 = G.clamp(c("cx") + c("w") / 2, 0.0, o.side), G.clamp(c("cy") + c("h") / 2, 0.0, o.side)
    inside = lambda v, size: F.least(F.greatest(v, F.lit(0.0)), size)
    u0, v0 = inside((x0 - c("pad_x")) / c("scale"), c("img_w")), inside((y0 - c("pad_y")) / c("scale"), c("img_h"))
    u1, v1 = inside((x1 - c("pad_x")) / c("scale"), c("img_w")), inside((y1 - c("pad_y")) / c("scale"), c("img_h"))
    idx = (F.array_position("scores", top) - 1).cast("int")
    out = anchors.select(*PAGE_KEY, c("anchor").alias("det_idx"), class_label(idx).alias("label"), idx.alias("class_idx"), top.cast("double").alias("confidence"), G.box(u0, v0, u1 - u0, v1 - v0).alias("box"))
    return out.where((c("confidence") >= o.min_confidence) & (c("box.w") > 0) & (c("box.h") > 0))


def decode_corners(rows: DataFrame, side: int = 640, least: float = 0.5) -> DataFrame:
    """Rows (page key, anchor, x0, y0, x1, y1 normalised, class_idx, confidence): no suppression, class index not kept."""
    c = F.col
    b = G.box(c("x0") * side, c("y0") * side, (c("x1") - c("x0")) * side, (c("y1") - c("y0")) * side)
    return rows.where(c("confidence") >= least).select(*PAGE_KEY, c("anchor").alias("det_idx"), class_label(c("class_idx"), F.lit("Unknown")).alias("label"), F.lit(-1).alias("class_idx"), "confidence", b.alias("box"))


def suppress(det: DataFrame, o: LayoutOptions = LayoutOptions()) -> DataFrame:
    """Greedy non-maximum suppression per page, whatever the class, by confidence; ties by det_idx.

    A fold over the page's detections stays in the JVM; a page holds few detections, and pages spread over the cluster.
    """
    cols = [x for x in det.columns if x not in PAGE_KEY]
    item = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("_o"), F.col("det_idx").alias("_i"), *cols)
    pages = det.groupBy(*PAGE_KEY).agg(F.array_sort(F.collect_list(item)).alias("d"))
    kind = dict(pages.dtypes)["d"]
    kept = F.aggregate("d", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: G.iou(k["box"], x["box"]) > o.max_iou), acc).otherwise(F.array_append(acc, x)))
    return pages.select(*PAGE_KEY, F.explode(kept).alias("k")).select(*PAGE_KEY, *[F.col(f"k.{x}").alias(x) for x in cols])


def overlaps(regions: DataFrame, blocks: DataFrame, o: CascadeOptions = CascadeOptions()) -> DataFrame:
    """Pairs of a region (det_idx, box) and a block (block_idx, box) of a page that overlap enough; many to many."""
    r = regions.select(*PAGE_KEY, "det_idx", F.col("box").alias("region_box"))
    b = blocks.join(r, PAGE_KEY)
    return b.withColumn("overlap", G.overlap_fraction(F.col("region_box"), F.col("box"))).where(F.col("overlap") >= o.min_overlap)


def assign(regions: DataFrame, blocks: DataFrame, key: str = "block_idx", o: CascadeOptions = CascadeOptions()) -> DataFrame:
    """Each block to the one region it overlaps most; ties to the lowest region; others leave."""
    pairs = overlaps(regions, blocks, o)
    best = Window.partitionBy(*PAGE_KEY, key).orderBy(F.desc("overlap"), "det_idx")
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def words_in_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words lying wholly inside a region of their page, bounds included."""
    r = regions.select(*PAGE_KEY, "det_idx", F.col("box").alias("region_box"))
    return words.join(r, PAGE_KEY).where(G.contains(F.col("region_box"), F.col("box"))).drop("region_box")


def text_components(parts: DataFrame, keys: list[str], page_w: Column, page_h: Column) -> DataFrame:
    """Components (box, area) of text size: not too large, sides within 30 to 1, at least the adaptive area of the group."""
    from pyspark.sql import Window

    from ..functions import stats as S

    w, h = F.col("box.w"), F.col("box.h")
    fit = parts.where((F.col("area") <= F.least(F.lit(50_000), page_w * page_h / 2)) & (F.greatest(w, h) <= 30 * F.greatest(F.least(w, h), F.lit(1.0))))
    least = S.adaptive_min_area(F.collect_list("box.h").over(Window.partitionBy(*keys)))
    return fit.withColumn("_least", least).where("area >= _least").drop("_least")


def line_components(parts: DataFrame, line_h: Column) -> DataFrame:
    """Components of a line that may be letters."""
    return parts.where((F.col("box.h") >= F.greatest(F.lit(2), F.floor(line_h / 6))) & (F.col("area") >= 4))
