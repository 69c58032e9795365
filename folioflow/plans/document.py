"""The whole way of a document: page images and words to detections' blocks, in reading order, merged, with counters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators import layout, order
from ..operators.models import Plugin
from ..schema import PAGE_KEY, CascadeOptions, OcrOptions, PreprocessOptions, WordSegmentation
from . import cascade, ocr
from .materialize import written


@dataclass(frozen=True)
class Models:
    lines: Plugin = Plugin("stub")
    tables: Plugin = Plugin("stub")
    regions: Plugin | None = Plugin("stub")  # reads whole regions when all else fails; none leaves them pending


@dataclass(frozen=True)
class Options:
    models: Models = field(default_factory=Models)
    ocr: OcrOptions = OcrOptions(segmentation=WordSegmentation.WINDOW)
    prep: PreprocessOptions = PreprocessOptions()
    cascade: CascadeOptions = CascadeOptions()


def blocks_of_pages(pages: DataFrame, words: DataFrame, detections: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(blocks with det_idx, stage and lines; detections left pending), not yet ordered.

    ``pages``: page key, img_w, img_h, channels, data; ``words``: page key, word_idx, text, box; all boxes in pixels.
    Tables go to their model, whose blocks are final. Other regions, tall ones dropped, go to the embedded words, then to the
    line recognizer, each gated by the mean confidence, and what is left to the region model.
    """
    det = layout.usable(detections).select(*PAGE_KEY, "det_idx", "label", "box")
    is_table = layout.is_table(F.col("label"))
    tables = ocr.region_blocks(pages, det.where(is_table), o.models.tables, split=False).withColumn("stage", F.lit("table"))
    strong = cascade.strong_text(words, ["word_idx"], o.cascade)
    stages = [
        cascade.Stage("L1", lambda pending: ocr.embedded_blocks(words, pending, strong), exclusive=False, costly=True),
        cascade.Stage("L2", lambda pending: ocr.ocr_blocks(pages, pending, o.models.lines, o.ocr, o.prep), costly=True),
    ]
    if o.models.regions is not None:
        stages.append(cascade.Stage("L3", lambda pending: ocr.region_blocks(pages, pending, o.models.regions, scored=False), gated=False, costly=True))
    settled, pending = cascade.run(det.where(~is_table), stages, o.cascade, ("label", "lines"))
    return settled.unionByName(tables.select(*settled.columns)), pending


def ordered(blocks: DataFrame) -> DataFrame:
    """Final blocks (page key, merged_no, label, confidence, box, lines, blocks): reading order, then paragraphs merged."""
    by = Window.partitionBy(*PAGE_KEY).orderBy("det_idx", "stage", "block_idx")
    b = blocks.withColumn("block_idx", (F.row_number().over(by) - 1).cast("int"))
    return order.merge_paragraphs(order.reading_order(b))


def page_log(blocks: DataFrame, pending: DataFrame) -> DataFrame:
    """What happened to each page: regions settled by stage, blocks, and regions left."""
    done = blocks.groupBy(*PAGE_KEY).agg(*[F.count_distinct(F.when(F.col("stage") == s, F.col("det_idx"))).alias(f"by_{s.lower()}") for s in ("L1", "L2", "L3", "table")], F.count(F.lit(1)).alias("blocks"))
    left = pending.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("left_over"))
    return done.join(left, PAGE_KEY, "full").na.fill(0)


def observed(blocks: DataFrame, name: str = "extraction") -> tuple[DataFrame, Observation]:
    """``blocks`` with running counters: pages and blocks are known once an action has run, without one of their own."""
    o = Observation(name)
    return blocks.observe(o, F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("stage") == "L1").alias("l1"), F.count_if(F.col("stage") == "L2").alias("l2"), F.count_if(F.col("stage") == "L3").alias("l3"), F.count_if(F.col("stage") == "table").alias("tables"), F.avg("confidence").alias("confidence")), o


def extract(pages: DataFrame, words: DataFrame, detections: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(final blocks, page log)."""
    blocks, pending = blocks_of_pages(pages, words, detections, o)
    blocks = written(blocks, "blocks")
    return ordered(blocks), page_log(blocks, pending)
