"""Order-dependent steps: reading order, lines, paragraphs, merging, strips, spans and windows.

Pages and blocks are the groups; their size is bounded by what a page holds, and they spread over the cluster. Folds
whose state feeds the next test run as higher-order functions inside the JVM plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..schema import BOX, LINE, PAGE_KEY


def islands(df: DataFrame, keys: list[str], start: Column, end: Column, order: list[Column], slack: float = 0.0, touch: bool = True, name: str = "island") -> DataFrame:
    """Number the groups of intervals that meet (within ``slack``) when taken in order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = (start > before + slack) if touch else (start >= before + slack)
    d = df.withColumn("_new", F.when(before.isNull() | apart, 1).otherwise(0))
    return d.withColumn(name, (F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def reading_order(blocks: DataFrame, idx: str = "block_idx") -> DataFrame:
    """Add band and reading_no: bands of vertically overlapping blocks from top to bottom, inside a band by x.

    A block joins a band only by an overlap greater than zero, so one without height is a band of its own; bands stand in
    the order of their first block. A null box comes first, ties go by y and index.
    """
    c = F.col
    by = Window.partitionBy(*PAGE_KEY).orderBy("box.y", idx)
    tall = F.coalesce(c("box.h") > 0, F.lit(False))
    d = blocks.withColumn("_before", F.max(F.when(tall, c("box.y") + c("box.h"))).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.struct(c("box.y").alias("y"), c(idx).alias("i"))
    opens = F.when(tall & (c("_before").isNull() | (c("box.y") >= c("_before"))), own)
    d = d.withColumn("_seed", F.when(tall, F.last(opens, True).over(by.rowsBetween(Window.unboundedPreceding, 0))).otherwise(own)).drop("_before")
    page = Window.partitionBy(*PAGE_KEY)
    d = d.withColumn("band", (F.dense_rank().over(page.orderBy("_seed")) - 1).cast("int"))
    return d.withColumn("reading_no", (F.row_number().over(page.orderBy("band", "box.x", "box.y", idx)) - 1).cast("int")).drop("_seed")


def build_lines(words: DataFrame, idx: str = "word_idx", keys: list[str] = PAGE_KEY) -> DataFrame:
    """Words with bottom, left and height (points, origin bottom left) to line numbers.

    Words are taken from the top; a word opens a line when its bottom is further from the running mean of the line's
    bottoms than half the height of the line's first word. Inside a line words stand by their left edge.
    """
    w = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("bottom")).alias("o"), F.col(idx).alias("i"), F.col("left").alias("l"), F.col("height").alias("h"), F.col("text").alias("t")))).alias("ws"))
    state = "struct<mean:double,n:int,tol:double,line:int,out:array<struct<line:int,l:double,i:bigint,t:string>>>"
    fold = f"""aggregate(ws, cast(named_struct('mean', 0D, 'n', 0, 'tol', 0D, 'line', -1, 'out', array()) as {state}),
        (a, x) -> if(a.n = 0 or abs(-x.o - a.mean) > a.tol,
            cast(named_struct('mean', -x.o, 'n', 1, 'tol', x.h * 0.5D, 'line', a.line + 1, 'out', array_append(a.out, named_struct('line', a.line + 1, 'l', x.l, 'i', cast(x.i as bigint), 't', x.t))) as {state}),
            cast(named_struct('mean', a.mean + (-x.o - a.mean) / (a.n + 1), 'n', a.n + 1, 'tol', a.tol, 'line', a.line, 'out', array_append(a.out, named_struct('line', a.line, 'l', x.l, 'i', cast(x.i as bigint), 't', x.t))) as {state})),
        a -> a.out)"""
    return w.select(*keys, F.explode(F.expr(fold)).alias("w")).select(*keys, F.col("w.line").alias("line_no"), F.col("w.l").alias("left"), F.col("w.i").alias(idx), F.col("w.t").alias("text"))


def line_texts(lines: DataFrame, idx: str = "word_idx", keys: list[str] = PAGE_KEY) -> DataFrame:
    return lines.groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", idx, "text"))), lambda x: x["text"]), " ").alias("text"))


def split_paragraphs(lines: DataFrame, key: str = "block_id", no: str = "line_no") -> DataFrame:
    """Add paragraph: a break stands before a line whose gap above is a peak, or that is indented after a line with a peak right border."""
    by = Window.partitionBy(key).orderBy(no)
    rank = F.row_number().over(by) - 1
    gap = F.coalesce(F.abs(F.col("box.y") - F.lag("box.y").over(by)), F.lit(0.0))
    d = lines.withColumns({"_i": rank, "_gap": gap, "_left": F.col("box.x"), "_right": F.col("box.x") + F.col("box.w")})
    whole = Window.partitionBy(key)
    d = d.withColumns({f"{c}s": F.collect_list(c).over(whole) for c in ("_gap", "_left", "_right")})
    peak = {}
    for c in ("_gap", "_left", "_right"):
        lo, hi = S.iqr_bounds(F.col(f"{c}s"))
        peak[c] = (F.size(f"{c}s") >= 3) & ((F.col(c) < lo) | (F.col(c) > hi))
    d = d.withColumns({"_pg": peak["_gap"], "_pl": peak["_left"], "_pr": peak["_right"]})
    brk = (F.col("_i") > 0) & (F.col("_pg") | (F.col("_pl") & F.coalesce(F.lag("_pr").over(by), F.lit(False))))
    d = d.withColumn("_b", brk.cast("int")).withColumn("paragraph", F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return d.select(*lines.columns, "paragraph")


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Fold over a page's blocks in order (reading_no): a block that goes on the text of the one before joins it.

    ``blocks``: page key, reading_no, label, confidence, box, lines (array of text and box). Both labels are ``Text``, both
    have lines, they share half of the narrower width, the gap is between -1 and 1.5 times the mean height of all lines
    of both (lines without height left out), and the first ends in a hyphen or, without a final mark, is followed by a small
    letter. A hyphen joins the two lines it stands between. The merged block, with its lines, feeds the next test.

    (page key, merged_no, label, confidence, box, lines, blocks).
    """
    heights = F.filter(F.transform("lines", lambda x: x["box"]["h"]), lambda h: h > 0)
    item = F.struct("reading_no", "label", F.col("confidence").cast("double").alias("confidence"), "box", "lines", F.aggregate(heights, F.lit(0.0), lambda a, h: a + h).alias("hs"), F.size(heights).alias("hn"))
    pages = blocks.withColumn("lines", F.coalesce("lines", F.array().cast(f"array<{LINE}>"))).groupBy(*PAGE_KEY).agg(F.array_sort(F.collect_list(item)).alias("bs"))
    state = f"struct<label:string,confidence:double,box:{BOX},lines:array<{LINE}>,hs:double,hn:int,n:int>"
    one = f"cast(named_struct('label', x.label, 'confidence', x.confidence, 'box', x.box, 'lines', x.lines, 'hs', x.hs, 'hn', x.hn, 'n', 1) as {state})"
    ox = "greatest(least(p.box.x + p.box.w, x.box.x + x.box.w) - greatest(p.box.x, x.box.x), 0D) / nullif(least(p.box.w, x.box.w), 0D)"
    lh = "((p.hs + x.hs) / nullif(p.hn + x.hn, 0))"
    gap = "(x.box.y - (p.box.y + p.box.h))"
    last, first = r"regexp_replace(element_at(p.lines, -1).text, '[\\s\\x{A0}]+$', '')", r"regexp_replace(x.lines[0].text, '^[\\s\\x{A0}]+', '')"
    goes_on = rf"({last} like '%-' or (length({last}) > 0 and not {last} rlike '[.!?:;]$' and {first} rlike '^\\p{{Ll}}'))"
    test = f"coalesce(p.label = 'Text' and x.label = 'Text' and size(p.lines) > 0 and size(x.lines) > 0 and {ox} >= 0.5D and {lh} > 0 and {gap} >= -1.0D * {lh} and {gap} <= 1.5D * {lh} and {goes_on}, false)"
    u = "named_struct('x', least(p.box.x, x.box.x), 'y', least(p.box.y, x.box.y), 'w', greatest(p.box.x + p.box.w, x.box.x + x.box.w) - least(p.box.x, x.box.x), 'h', greatest(p.box.y + p.box.h, x.box.y + x.box.h) - least(p.box.y, x.box.y))"
    glued = f"named_struct('text', concat(left({last}, length({last}) - 1), {first}), 'box', element_at(p.lines, -1).box)"
    lines = f"if({last} like '%-', concat(slice(p.lines, 1, size(p.lines) - 1), array({glued}), slice(x.lines, 2, size(x.lines))), concat(p.lines, x.lines))"
    # the heights are those of the lines that are left: a joined line keeps the first one's box
    kept = f"if({last} like '%-' and x.lines[0].box.h > 0, x.lines[0].box.h, 0D)"
    both = f"cast(named_struct('label', p.label, 'confidence', (p.confidence + x.confidence) / 2, 'box', {u}, 'lines', {lines}, 'hs', p.hs + x.hs - {kept}, 'hn', p.hn + x.hn - if({kept} > 0, 1, 0), 'n', p.n + x.n) as {state})".replace("p.n + x.n", "p.n + 1")
    fold = f"""aggregate(bs, cast(array() as array<{state}>), (a, x) -> if(size(a) = 0, array({one}),
        element_at(transform(array(element_at(a, -1)), p -> if({test}, array_append(slice(a, 1, size(a) - 1), {both}), array_append(a, {one}))), 1)))"""
    out = pages.select(*PAGE_KEY, F.posexplode(F.expr(fold)).alias("merged_no", "m"))
    return out.select(*PAGE_KEY, "merged_no", F.col("m.label").alias("label"), F.col("m.confidence").alias("confidence"), F.col("m.box").alias("box"), F.col("m.lines").alias("lines"), F.col("m.n").alias("blocks"))


def line_strips(runs: DataFrame, keys: list[str], pad: int = 4) -> DataFrame:
    """Rows of ink components (top, bottom) to full-width strips; touching components share one."""
    d = islands(runs, keys, F.col("top"), F.col("bottom"), [F.col("top"), F.col("bottom")], name="strip")
    return d.groupBy(*keys, "strip").agg(F.greatest(F.min("top") - pad, F.lit(0)).alias("top"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("components"))


def merge_spans(spans: DataFrame, keys: list[str], slack: float = 2.0) -> DataFrame:
    """Horizontal spans (left, right) within ``slack`` of each other become one."""
    d = islands(spans, keys, F.col("left"), F.col("right"), [F.col("left"), F.col("right")], slack=slack, name="span")
    return d.groupBy(*keys, "span").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count(F.lit(1)).alias("parts"))


def pack_windows(segments: DataFrame, keys: list[str], width: int = 600) -> DataFrame:
    """Greedy windows over segments (start, end): a window grows while it stays within ``width``."""
    g = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e")))).alias("segs"))
    win = "array<struct<s:int,e:int>>"
    fold = f"""aggregate(segs, cast(array() as {win}), (a, x) -> if(size(a) > 0 and x.e - element_at(a, -1).s + 1 <= {width},
        array_append(slice(a, 1, size(a) - 1), named_struct('s', element_at(a, -1).s, 'e', x.e)), array_append(a, named_struct('s', x.s, 'e', x.e))))"""
    return g.select(*keys, F.posexplode(F.expr(fold)).alias("window_no", "w")).select(*keys, "window_no", F.col("w.s").alias("start"), F.col("w.e").alias("end"))


def median_height_filter(lines: DataFrame, keys: list[str], ratio: float = 0.5) -> DataFrame:
    """Drop lines under ``ratio`` of the median height where there are at least three; never all of them."""
    by = Window.partitionBy(*keys)
    d = lines.withColumns({"_n": F.count(F.lit(1)).over(by), "_m": F.percentile("box.h", F.lit(0.5)).over(by), "_top": F.max("box.h").over(by)})
    keep = (F.col("_n") < 3) | (F.col("box.h") >= F.col("_m") * ratio) | (F.col("_top") < F.col("_m") * ratio)
    return d.where(keep).select(*lines.columns)


def width_batches(lines: DataFrame, keys: list[str], width: Column, order: str, size: int = 32) -> DataFrame:
    """Batches of similar width for a recognizer: sorted by width, ``size`` at a time."""
    by = Window.partitionBy(*keys).orderBy(width, order)
    return lines.withColumn("batch", F.floor((F.row_number().over(by) - 1) / size).cast("int"))


def runs(columns: DataFrame, keys: list[str], pos: str, on: Column, least_gap: int = 1) -> DataFrame:
    """Maximal runs (start, end) of positions where ``on`` holds; a run ends at a gap of at least ``least_gap`` others."""
    by = Window.partitionBy(*keys).orderBy(pos)
    d = columns.where(on).withColumn("_new", F.coalesce((F.col(pos) - F.lag(pos).over(by) > least_gap).cast("int"), F.lit(1)))
    d = d.withColumn("run", (F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return d.groupBy(*keys, "run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"))


def column_gaps(profile: DataFrame, keys: list[str], pos: str, count: str, height: Column, width: Column) -> DataFrame:
    """Gaps (start, end) between text columns: columns with at most 5 % ink, at least max(8, W / 50) wide, inside 10 % margins.

    ``profile``: one row per column; height and width are columns of it.
    """
    p = profile.withColumns({"_h": height.cast("double"), "_w": width.cast("double")})
    size = p.groupBy(*keys).agg(F.max("_w").alias("_w"))
    r = runs(p, keys, pos, F.col(count) <= F.col("_h") * 0.05).join(size, keys)
    wide = F.col("end") - F.col("start") + 1 >= F.greatest(F.lit(8.0), F.floor(F.col("_w") / 50))
    return r.where(wide & (F.col("start") > F.col("_w") * 0.1) & (F.col("end") < F.col("_w") * 0.9)).select(*keys, "start", "end")


def component_order(boxes: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Components from top to bottom, then left to right."""
    by = Window.partitionBy(*keys).orderBy("box.y", "box.x", idx)
    return boxes.withColumn("component_no", (F.row_number().over(by) - 1).cast("int"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
