"""Confidence-gated cascade: cheap extractors first, what they cannot settle goes on to dearer ones.

A stage is an extractor (pending detections to blocks), a way to tie blocks to detections, and a gate on the mean
confidence of a detection's blocks. Settled detections leave by an anti-join. Each stage's blocks are written to the
shared folder where the extractor is costly, since both the settled and the pending side read them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..schema import PAGE_KEY, CascadeOptions
from .materialize import written

DET_KEY = [*PAGE_KEY, "det_idx"]


@dataclass(frozen=True)
class Stage:
    name: str
    extract: Callable[[DataFrame], DataFrame]  # pending detections -> blocks (page key, block_idx, box, confidence, text)
    exclusive: bool = True  # a block belongs to one detection only
    gated: bool = True
    costly: bool = False


def gate(pairs: DataFrame, o: CascadeOptions) -> DataFrame:
    """Detections whose blocks have a mean confidence over the gate."""
    return pairs.groupBy(*DET_KEY).agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("blocks")).where(F.col("mean_confidence") >= o.gate)


def run(detections: DataFrame, stages: list[Stage], o: CascadeOptions = CascadeOptions(), keep: tuple[str, ...] = ("text",)) -> tuple[DataFrame, DataFrame]:
    """(settled blocks with det_idx and stage, detections left pending). ``keep``: further columns of the blocks.

    The last resort (``gated=False``) settles whatever it finds in the region it was found for, and leaves nothing pending.
    """
    pending, out = detections, []
    for s in stages:
        found = s.extract(pending)
        if s.costly:
            found = written(found, f"stage-{s.name}")
        if not s.gated and "det_idx" in found.columns:
            out.append(found.select(*DET_KEY, "block_idx", "box", "confidence", *keep, F.lit(s.name).alias("stage")))
            pending = pending.limit(0)
            continue
        found = found.drop("det_idx")
        pairs = layout.assign(pending.select(*DET_KEY, "box"), found, o=o) if s.exclusive else layout.overlaps(pending.select(*DET_KEY, "box"), found, o)
        if s.gated:
            done = gate(pairs, o).select(*DET_KEY)
            pairs = pairs.join(done, DET_KEY, "left_semi")
        else:
            done = pairs.select(*DET_KEY).distinct()
        out.append(pairs.select(*DET_KEY, "block_idx", "box", "confidence", *keep, F.lit(s.name).alias("stage")))
        pending = pending.join(done, DET_KEY, "left_anti")
    return reduce(DataFrame.unionByName, out), pending


def strong_text(words: DataFrame, order: list, o: CascadeOptions = CascadeOptions()) -> DataFrame:
    """Pages whose first words look like text: few control signs and no heavily overlapping neighbours.

    ``words``: page key, text, box. A page without letters fails.
    """
    from pyspark.sql import Window

    from ..functions import geometry as G

    by = Window.partitionBy(*PAGE_KEY).orderBy(*order)
    w = words.withColumn("_i", F.row_number().over(by)).withColumn("_next", F.lead("box").over(by)).where(F.col("_i") <= o.strong_words)
    w = w.withColumn("_iou", F.when((F.col("_i") < o.strong_words) & F.col("_next").isNotNull(), G.iou(F.col("box"), F.col("_next"))).otherwise(F.lit(0.0)))
    g = w.groupBy(*PAGE_KEY).agg(F.sum(F.length("text")).alias("letters"), F.sum(F.regexp_count("text", F.lit(r"\p{Cc}"))).alias("controls"), F.max("_iou").alias("worst_overlap"))
    if o.max_chars is not None:
        g = g.where(F.col("letters") <= o.max_chars).unionByName(g.where(F.col("letters") > o.max_chars).withColumn("worst_overlap", F.lit(float("inf"))))
    ok = (F.col("letters") > 0) & (F.col("controls") <= o.max_control * F.col("letters")) & (F.col("worst_overlap") <= o.max_word_iou)
    return g.withColumn("strong", F.coalesce(ok, F.lit(False)))
