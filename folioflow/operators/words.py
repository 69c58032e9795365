"""Word boundaries in a line from the gaps between its ink segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def segment_gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add span_no and gap (to the span before, null for the first) to spans (left, right)."""
    by = Window.partitionBy(*keys).orderBy("left", "right")
    return spans.withColumn("span_no", (F.row_number().over(by) - 1).cast("int")).withColumn("gap", F.greatest(F.col("left") - F.lag("right").over(by), F.lit(0)))


def boundaries(gaps: DataFrame, keys: list[str], method: str, deep: Column | None = None) -> DataFrame:
    """Add word: number of the word a span belongs to. All spans of a line without a clear split are one word.

    ``cca`` and ``aom`` split at gaps over the Otsu threshold, ``rlsa`` at gaps over the rounded mean. For ``cca`` and
    ``rlsa`` a line splits only when its widest gap is at least twice its narrowest, for ``rlsa`` also when the mean wide
    gap is twice the narrow. For ``aom`` a gap must also be ``deep`` (nearly free of ink).
    """
    by = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys).orderBy("span_no").rowsBetween(Window.unboundedPreceding, 0)
    d = gaps.withColumn("_all", F.collect_list(F.col("gap").cast("int")).over(by))
    limit: Column = F.bround(F.aggregate("_all", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("_all"), F.lit(0))) if method == "rlsa" else S.otsu(F.col("_all"))
    d = d.withColumn("_limit", limit)
    wide, narrow = F.filter("_all", lambda v: v > F.col("_limit")), F.filter("_all", lambda v: v <= F.col("_limit"))
    clear = F.coalesce(F.array_max("_all") >= 2 * F.greatest(F.lit(1), F.array_min("_all")), F.lit(False))
    if method == "rlsa":
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v) / F.nullif(F.size(a), F.lit(0))
        clear = clear & F.coalesce(mean(wide) >= 2 * mean(narrow), F.lit(False))
    if method == "aom":
        clear = F.lit(True) if deep is None else F.coalesce(deep, F.lit(False))
    cut = F.when(clear & F.coalesce(F.col("gap") > F.col("_limit"), F.lit(False)), 1).otherwise(0)
    return d.withColumn("word", F.sum(cut).over(order).cast("int")).select(*gaps.columns, "word")
