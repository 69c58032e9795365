"""Registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import quality as Q
from ..functions import sqlfuncs
from ..functions import stats as S
from ..operators import cluster, decode, layout, order, words
from ..operators.models import Plugin
from ..schema import ATOMIC, LABELS, LINE, PAGE_KEY, CascadeOptions, OcrOptions, PreprocessOptions, WordSegmentation
from ..sources import files, sinks
from . import cascade, document, ocr

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
PK = "extraction_id, page_no"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.bround(x.cast("double"), 6)


def flat(b: Column, prefix: str = "b") -> list[Column]:
    return [r6(b[k]).alias(f"{prefix}{k}") for k in "xywh"]


def sql_flat(x: str, y: str, w: str, h: str, prefix: str = "b") -> str:
    return ", ".join(f"round_even({e}, 6) as {prefix}{k}" for k, e in zip("xywh", (x, y, w, h)))


def distinct_by(df: DataFrame, key: str, by: list[str] | None) -> DataFrame:
    """Exact copies of a row once. With ``by``, the group that is formed next, copies meet in the exchange of that group."""
    return df.dropDuplicates([key]) if by is None else df.repartition(*[F.col(c) for c in by]).dropDuplicates([*by, key])


def lines_of(s: SparkSession, d: str, by: list[str] | None = None) -> DataFrame:
    return distinct_by(table(s, d, "text_lines").where("line_id is not null"), "line_id", by)


def blocks_of(s: SparkSession, d: str, by: list[str] | None = None) -> DataFrame:
    return distinct_by(table(s, d, "blocks").where("block_id is not null"), "block_id", by)


BLOCK_KEY = ["block_id"]
LINES = "(select distinct on (line_id) * from text_lines order by line_id)"
BLOCKS = "(select distinct on (block_id) * from blocks order by block_id)"
B2 = "b.box.x, b.box.y, b.box.w, b.box.h"

# -- projections ------------------------------------------------------------------------------------------------------


@query(f"""select d.extraction_id, d.page_no, det_idx, {sql_flat('box.x * img_w / 640.0', 'box.y * img_h / 640.0', 'box.w * img_w / 640.0', 'box.h * img_h / 640.0')}
from detections d join page_info p on d.extraction_id = p.extraction_id and d.page_no = p.page_no""")
def scale_boxes(s, d):
    """Model space to image pixels."""
    j = table(s, d, "detections").join(table(s, d, "page_info").select(*PAGE_KEY, "img_w", "img_h"), PAGE_KEY)
    return j.select(*PAGE_KEY, "det_idx", *flat(G.scaled(F.col("box"), G.model_scale(F.col("img_w")), G.model_scale(F.col("img_h")))))


@query(f"""select d.extraction_id, d.page_no, det_idx, {sql_flat('box.x * pdf_w_pt / img_w', 'pdf_h_pt - (box.y + box.h) * pdf_h_pt / img_h', 'box.w * pdf_w_pt / img_w', 'box.h * pdf_h_pt / img_h')}
from detections d join page_info p on d.extraction_id = p.extraction_id and d.page_no = p.page_no where pdf_w_pt > 0""")
def map_pdf_space(s, d):
    """Image pixels to points with a flipped y axis."""
    j = table(s, d, "detections").join(table(s, d, "page_info").where("pdf_w_pt > 0"), PAGE_KEY)
    return j.select(*PAGE_KEY, "det_idx", *flat(G.to_pdf(F.col("box"), F.col("img_w"), F.col("img_h"), F.col("pdf_w_pt"), F.col("pdf_h_pt"))))


@query("""select extraction_id, page_no, round_even(sc, 9) as scale, trunc(img_w * sc)::int as scaled_w, trunc(img_h * sc)::int as scaled_h, (640 - trunc(img_w * sc)::int) / 2.0::double as pad_x, (640 - trunc(img_h * sc)::int) / 2.0::double as pad_y
from (select *, least(640 / img_w::double, 640 / img_h::double) as sc from page_info)""")
def letterbox_params(s, d):
    """Scale and padding into a square."""
    p = table(s, d, "page_info")
    b = G.letterbox(F.col("img_w"), F.col("img_h"))
    return p.select(*PAGE_KEY, F.bround(b["scale"], 9).alias("scale"), b["scaled_w"].alias("scaled_w"), b["scaled_h"].alias("scaled_h"), b["pad_x"].alias("pad_x"), b["pad_y"].alias("pad_y"))


@query("""select * from (select d.extraction_id, d.page_no, det_idx, greatest(trunc(box.x * 5)::int, 0) as crop_x, greatest(trunc(box.y * 5)::int, 0) as crop_y,
 least(trunc(box.w * 5)::int, img_w - greatest(trunc(box.x * 5)::int, 0)) as crop_w, least(trunc(box.h * 5)::int, img_h - greatest(trunc(box.y * 5)::int, 0)) as crop_h
 from detections d join page_info p on d.extraction_id = p.extraction_id and d.page_no = p.page_no) where crop_w > 0 and crop_h > 0""")
def crop_rects(s, d):
    """Pixel rectangles of the detections at five times their size; empty ones leave."""
    j = table(s, d, "detections").join(table(s, d, "page_info").select(*PAGE_KEY, "img_w", "img_h"), PAGE_KEY)
    b = G.crop(G.scaled(F.col("box"), F.lit(5.0), F.lit(5.0)), F.col("img_w"), F.col("img_h"))
    return j.select(*PAGE_KEY, "det_idx", *[e.alias(k) for k, e in b.items()]).where("crop_w > 0 and crop_h > 0")


@query("""select l.line_id, round_even(l.box.x + b.box.x, 6) as bx, round_even(l.box.y + b.box.y, 6) as by, l.box.w as bw, l.box.h as bh from """ + LINES + """ l join """ + BLOCKS + """ b on l.block_id = b.block_id""")
def component_to_page(s, d):
    """Boxes local to a block moved to the page."""
    b = table(s, d, "blocks").select("block_id", F.col("box").alias("outer")).dropDuplicates(["block_id"])
    return lines_of(s, d, BLOCK_KEY).join(b, "block_id").select("line_id", *flat(G.moved(F.col("box"), F.col("outer.x"), F.col("outer.y"))))


@query("""select extraction_id, page_no, det_idx, coalesce(nullif(trim(label), ''), 'Text') as label, case when class_idx between 0 and 10 then ['""" + "','".join(LABELS) + """'][class_idx + 1] else 'Class_' || class_idx end as class_label,
 case when class_idx between 0 and 10 then ['""" + "','".join(LABELS) + """'][class_idx + 1] else 'Unknown' end as strict_label, coalesce(lower(label) in ('title', 'section header', 'caption', 'page header', 'page footer'), false) as atomic from detections""")
def class_labels(s, d):
    """Default label, label of the class index (two fallbacks), and the atomic test."""
    c = F.col
    return table(s, d, "detections").select(*PAGE_KEY, "det_idx", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Text")).alias("label"), layout.class_label(c("class_idx")).alias("class_label"), layout.class_label(c("class_idx"), F.lit("Unknown")).alias("strict_label"), F.coalesce(F.lower("label").isin(*ATOMIC), F.lit(False)).alias("atomic"))


@query(f"""select extraction_id, page_no, {sql_flat('min(box.x)', 'min(box.y)', 'max(box.x + box.w) - min(box.x)', 'max(box.y + box.h) - min(box.y)')}, count(*) as n from {LINES} group by all""")
def union_boxes(s, d):
    """The box around all lines of a page."""
    return lines_of(s, d, PAGE_KEY).groupBy(*PAGE_KEY).agg(G.union_agg(F.col("box")).alias("u"), F.count(F.lit(1)).alias("n")).select(*PAGE_KEY, *flat(F.col("u")), "n")


_PAIR = """select *, greatest(0, least(ax + aw, cx + cw) - greatest(ax, cx)) * greatest(0, least(ay + ah, cy + ch) - greatest(ay, cy)) as i,
 greatest(0, ax - (cx + cw), cx - (ax + aw)) as dx, greatest(0, ay - (cy + ch), cy - (ay + ah)) as dy,
 abs(degrees(atan2((cy + ch / 2) - (ay + ah / 2), (cx + cw / 2) - (ax + aw / 2)))) as ang
from (select extraction_id, page_no, det_idx, box.x as ax, box.y as ay, box.w as aw, box.h as ah, lead(box.x) over w as cx, lead(box.y) over w as cy, lead(box.w) over w as cw, lead(box.h) over w as ch from detections window w as (partition by extraction_id, page_no order by det_idx)) where cx is not null"""


@query(f"""select extraction_id, page_no, det_idx, round_even(sqrt(dx * dx + dy * dy), 6) as gap, round_even(ang, 6) as angle, ang <= 40 or ang >= 140 as horizontal, ax <= cx + cw and cx <= ax + aw as meets_x,
 round_even(case when aw * ah + cw * ch - i > 0 then i / (aw * ah + cw * ch - i) else 0 end, 6) as iou, round_even(case when cw * ch > 0 then i / (cw * ch) else 0 end, 6) as overlap,
 round_even(case when least(aw, cw) > 0 then greatest(0, least(ax + aw, cx + cw) - greatest(ax, cx)) / least(aw, cw) else 0 end, 6) as overlap_x from ({_PAIR})""")
def box_pairs(s, d):
    """All two-box measures between each detection and the next."""
    by = Window.partitionBy(*PAGE_KEY).orderBy("det_idx")
    p = table(s, d, "detections").withColumn("c", F.lead("box").over(by)).where("c is not null")
    a, c = F.col("box"), F.col("c")
    ang = G.angle(a, c)
    return p.select(*PAGE_KEY, "det_idx", r6(G.gap_distance(a, c)).alias("gap"), r6(ang).alias("angle"), G.is_horizontal(ang).alias("horizontal"), G.overlaps_x(a, c).alias("meets_x"), r6(G.iou(a, c)).alias("iou"), r6(G.overlap_fraction(a, c)).alias("overlap"), r6(G.overlap_x_fraction(a, c)).alias("overlap_x"))


# -- filters ----------------------------------------------------------------------------------------------------------


@query("""select extraction_id, page_no, det_idx, coalesce(lower(label) = 'table', false) as is_table from detections where confidence >= 0.25 and box.w > 0 and box.h > 0 and (coalesce(lower(label) = 'table', false) or box.w <= 0 or box.h / box.w < 3.0)""")
def usable_detections(s, d):
    """Confidence, area and aspect filters; tables pass the aspect test."""
    return layout.usable(table(s, d, "detections")).select(*PAGE_KEY, "det_idx", layout.is_table(F.col("label")).alias("is_table"))


@query("""select extraction_id, page_no, det_idx, confidence from detections where confidence >= 0.5""")
def strict_confidence(s, d):
    return table(s, d, "detections").where("confidence >= 0.5").select(*PAGE_KEY, "det_idx", "confidence")


@query(f"""with l as {LINES}, m as (select *, count(*) over w as n, quantile_cont(box.h, 0.5) over w as m, max(box.h) over w as top from l window w as (partition by block_id))
select line_id, block_id, box.h as h from m where n < 3 or box.h >= m * 0.5 or top < m * 0.5""")
def median_height_lines(s, d):
    """Lines that are not much lower than the median of their block."""
    return order.median_height_filter(lines_of(s, d, BLOCK_KEY), ["block_id"]).select("line_id", "block_id", F.col("box.h").alias("h"))


@query("""select line_id from text_lines where regexp_matches(text, '\\S') and box.h >= 3 and box.w >= 2 group by line_id""")
def visible_lines(s, d):
    """Lines with text and a size over the noise limits."""
    return lines_of(s, d).where(Q.not_blank(F.col("text")) & (F.col("box.h") >= 3) & (F.col("box.w") >= 2)).select("line_id")


# -- joins ------------------------------------------------------------------------------------------------------------


@query(f"""select l.line_id, r.det_idx from {LINES} l join detections r on l.extraction_id = r.extraction_id and l.page_no = r.page_no
 where l.box.x >= r.box.x and l.box.y >= r.box.y and l.box.x + l.box.w <= r.box.x + r.box.w and l.box.y + l.box.h <= r.box.y + r.box.h""")
def words_in_regions(s, d):
    """Lines lying wholly inside a detection."""
    return layout.words_in_regions(lines_of(s, d, PAGE_KEY), table(s, d, "detections")).select("line_id", "det_idx")


_OV = f"""select b.extraction_id, b.page_no, b.block_idx, r.det_idx, b.confidence,
 case when b.box.w * b.box.h > 0 then greatest(0, least(r.box.x + r.box.w, b.box.x + b.box.w) - greatest(r.box.x, b.box.x)) * greatest(0, least(r.box.y + r.box.h, b.box.y + b.box.h) - greatest(r.box.y, b.box.y)) / (b.box.w * b.box.h) else 0 end as overlap
 from {BLOCKS} b join detections r on b.extraction_id = r.extraction_id and b.page_no = r.page_no"""


@query(f"select extraction_id, page_no, block_idx, det_idx, round_even(overlap, 6) as overlap from ({_OV}) where overlap >= 0.5")
def overlap_pairs(s, d):
    """Blocks with every detection they overlap by half."""
    b = blocks_of(s, d, PAGE_KEY)
    return layout.overlaps(table(s, d, "detections"), b).select(*PAGE_KEY, "block_idx", "det_idx", r6(F.col("overlap")).alias("overlap"))


@query(f"select extraction_id, page_no, block_idx, det_idx, round_even(overlap, 6) as overlap from ({_OV}) where overlap >= 0.5 qualify row_number() over (partition by extraction_id, page_no, block_idx order by overlap desc, det_idx) = 1")
def assigned_blocks(s, d):
    """Each block with the one detection it overlaps most."""
    b = blocks_of(s, d, PAGE_KEY)
    return layout.assign(table(s, d, "detections"), b).select(*PAGE_KEY, "block_idx", "det_idx", r6(F.col("overlap")).alias("overlap"))


@query("""with d as (select extraction_id, page_no, list({'i': det_idx, 'c': confidence, 'x': box.x, 'y': box.y, 'w': box.w, 'h': box.h} order by confidence desc, det_idx) as l from detections group by all),
k as (select extraction_id, page_no, unnest(list_reduce(l, lambda a, b: case when len(list_filter(a, lambda k: (greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)))
 / (k.w * k.h + b.w * b.h - greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y))) > 0.45)) > 0 then a else list_append(a, b) end, l[1:0])) as r from d)
select extraction_id, page_no, r.i as det_idx, r.c as confidence from k""")
def layout_nms(s, d):
    """Greedy suppression of overlapping detections."""
    return layout.suppress(table(s, d, "detections")).select(*PAGE_KEY, "det_idx", "confidence")


@query("""select a.extraction_id, a.page_no, a.det_idx, coalesce(lower(a.label) = 'table', false) as is_table, round_even(b.y_pdf, 6) as y_pdf from detections a
 join (select d.extraction_id, d.page_no, det_idx, pdf_h_pt - (box.y + box.h) * pdf_h_pt / img_h as y_pdf from detections d join page_info p on d.extraction_id = p.extraction_id and d.page_no = p.page_no) b
 on a.extraction_id = b.extraction_id and a.page_no = b.page_no and a.det_idx = b.det_idx""")
def both_spaces(s, d):
    """Image and PDF boxes of a detection side by side, kept in one row instead of two aligned lists."""
    j = table(s, d, "detections").join(table(s, d, "page_info").select(*PAGE_KEY, "img_w", "img_h", "pdf_w_pt", "pdf_h_pt"), PAGE_KEY)
    pdf = G.to_pdf(F.col("box"), F.col("img_w"), F.col("img_h"), F.col("pdf_w_pt"), F.col("pdf_h_pt"))
    return j.select(*PAGE_KEY, "det_idx", layout.is_table(F.col("label")).alias("is_table"), r6(pdf["y"]).alias("y_pdf"))


_KNN = f"""select a.extraction_id, a.page_no, a.line_id as a, b.line_id as b, a.box as ba, b.box as bb,
 sqrt(power(greatest(0, a.box.x - (b.box.x + b.box.w), b.box.x - (a.box.x + a.box.w)), 2) + power(greatest(0, a.box.y - (b.box.y + b.box.h), b.box.y - (a.box.y + a.box.h)), 2)) as dist,
 abs(degrees(atan2((b.box.y + b.box.h / 2) - (a.box.y + a.box.h / 2), (b.box.x + b.box.w / 2) - (a.box.x + a.box.w / 2)))) as ang
 from {LINES} a join {LINES} b on a.extraction_id = b.extraction_id and a.page_no = b.page_no and a.line_id <> b.line_id"""


@query(f"select extraction_id, page_no, a, b, round_even(dist, 6) as distance, round_even(ang, 6) as angle from ({_KNN}) qualify row_number() over (partition by extraction_id, page_no, a order by dist, b) <= 5")
def nearest_lines(s, d):
    """The five nearest lines of each line on its page."""
    return cluster.neighbours(lines_of(s, d), PAGE_KEY, "line_id", 5).select(*PAGE_KEY, "a", "b", r6(F.col("distance")).alias("distance"), r6(F.col("angle")).alias("angle"))


_EDGES = f"""with n as (select *, ang <= 40 or ang >= 140 as flat from ({_KNN}) qualify row_number() over (partition by extraction_id, page_no, a order by dist, b) <= 5),
m as (select extraction_id, page_no, median(dist) filter (flat) as mh, median(dist) filter (not flat) as mv from n group by all),
h as (select extraction_id, page_no, avg(box.h) as hh from {LINES} group by all),
l as (select m.extraction_id, m.page_no, case when mh > 0 then mh * 2.5 else hh * 0.2 end as th, case when mv > 0 then mv * 1.6 else hh end as tv from m join h on m.extraction_id = h.extraction_id and m.page_no = h.page_no),
e as (select n.extraction_id, n.page_no, a, b from n join l on n.extraction_id = l.extraction_id and n.page_no = l.page_no where flat and dist <= th or not flat and dist <= tv and ba.x <= bb.x + bb.w and bb.x <= ba.x + ba.w)"""


@query(_EDGES + " select * from e")
def cluster_edges(s, d):
    """Edges between lines that stand close, by thresholds of the page."""
    return cluster.word_edges(lines_of(s, d), PAGE_KEY, "line_id")


@query(_EDGES.replace("with n as", "with recursive n as") + f""", u as (select extraction_id, page_no, a, b from e union select extraction_id, page_no, b, a from e),
r as (select extraction_id, page_no, line_id as a, line_id as root from {LINES} union select u.extraction_id, u.page_no, u.b, r.root from r join u on r.extraction_id = u.extraction_id and r.page_no = u.page_no and r.a = u.a)
select extraction_id, page_no, a as line_id, min(root) as cluster from r group by all""")
def line_clusters(s, d):
    """Connected groups of close lines."""
    lines = lines_of(s, d)
    return cluster.groups(lines, cluster.word_edges(lines, PAGE_KEY, "line_id"), PAGE_KEY, "line_id")


# -- statistics -------------------------------------------------------------------------------------------------------


def _lengths(s, d):
    return lines_of(s, d, BLOCK_KEY).where("text is not null").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_id", F.length("text").alias("n")))).alias("ls")).select("block_id", F.transform("ls", lambda x: x["n"].cast("double")).alias("v"))


_LEN = f"(select block_id, list(length(text)::double order by line_no, line_id) as v, list_sort(list(length(text)::double)) as s from {LINES} where text is not null group by block_id)"


@query(f"""select block_id, coalesce(array_to_string(list_filter(range(len(v)), lambda i: v[i + 1] < s[(len(v) * 0.25)::decimal(18,4)::double.floor()::int + 1] - greatest(1.5 * (s[floor(len(v) * 0.75)::int + 1] - s[floor(len(v) * 0.25)::int + 1]), 5)
 or v[i + 1] > s[floor(len(v) * 0.75)::int + 1] + greatest(1.5 * (s[floor(len(v) * 0.75)::int + 1] - s[floor(len(v) * 0.25)::int + 1]), 5)), ','), '') as peaks from {_LEN} where len(v) >= 3""".replace("(len(v) * 0.25)::decimal(18,4)::double.floor()::int", "floor(len(v) * 0.25)::int"))
def iqr_peaks(s, d):
    """Lines of unusual length in their block."""
    return _lengths(s, d).where("size(v) >= 3").select("block_id", F.array_join(S.iqr_peaks(F.col("v")).cast("array<string>"), ",").alias("peaks"))


@query(f"""select block_id, s[least(len(s) - 1, floor(len(s) * 0.9)::int)::int + 1] as p90, (s[floor((len(s) - 1) / 2)::int + 1] + s[floor(len(s) / 2)::int + 1]) / 2 as median, s[floor(len(s) / 2)::int + 1] as upper_median from {_LEN}""")
def length_ranks(s, d):
    """Nearest-rank percentile and both medians of line lengths."""
    v = F.col("v")
    return _lengths(s, d).select("block_id", S.nearest_rank(v, 0.9).alias("p90"), S.median(v).alias("median"), S.upper_median(v).alias("upper_median"))


@query(f"""with h as (select extraction_id, page_no, list_sort(list(box.h)) as s from {LINES} group by all), m as (select *, s[floor(len(s) / 4)::int + 1 : floor(len(s) * 3 / 4)::int] as mid from h)
select extraction_id, page_no, case when len(mid) = 0 then 4 else greatest(4, floor(power(list_sum(mid) / len(mid) * 0.25, 2))::int) end as least_area from m""")
def adaptive_area(s, d):
    """Least component area of a page from the middle half of its heights."""
    g = lines_of(s, d, PAGE_KEY).groupBy(*PAGE_KEY).agg(F.collect_list("box.h").alias("hs"))
    return g.select(*PAGE_KEY, S.adaptive_min_area(F.col("hs")).alias("least_area"))


@query(f"""with v as (select block_id, length(text)::int as x from {LINES} where text is not null), t as (select v.block_id, u.t, count(*) filter (x <= t) as k, count(*) as n, sum(x) filter (x <= t)::double as s, sum(x)::double as a
 from v join (select distinct block_id, x as t from v) u on v.block_id = u.block_id group by all), g as (select block_id, t, case when k > 0 and k < n then k::double * (n - k) * power(s / k - (a - s) / (n - k), 2) else 0 end as g, max(t) over (partition by block_id) as top from t)
select block_id, case when max(top) <= 0 or max(g) <= 0 then 0 else arg_max(t, {{'g': g, 't': -t}}) end as threshold from g group by block_id""")
def otsu_lengths(s, d):
    """Otsu's threshold over the line lengths of a block."""
    return _lengths(s, d).select("block_id", S.otsu(F.transform("v", lambda x: x.cast("int"))).cast("int").alias("threshold"))


def _sql_breaks(src: str, p: str) -> str:
    """CTEs ending in {p}out (extraction_id, page_no, break_at, p90): natural break of ``src`` (extraction_id, page_no, x) per page."""
    return f"""{p}v as (select extraction_id, page_no, x, row_number() over (partition by extraction_id, page_no order by x) as i, count(*) over (partition by extraction_id, page_no) as n from {src}),
{p}c as (select *, sum(x) over w as s, sum(x * x) over w as q, sum(x) over a as ts, sum(x * x) over a as tq, lead(x) over (partition by extraction_id, page_no order by i) as nx from {p}v window w as (partition by extraction_id, page_no order by i rows unbounded preceding), a as (partition by extraction_id, page_no)),
{p}k as (select *, round(q - s * s / i + (tq - q) - (ts - s) * (ts - s) / (n - i), 6) as wss from {p}c where i >= greatest(2, n // 10) and i <= greatest(n - greatest(2, n // 10), greatest(2, n // 10)) and i < n),
{p}b as (select extraction_id, page_no, arg_min({{'lo': x, 'hi': nx}}, {{'w': wss, 'i': i}}) as b from {p}k where n >= 10 group by all),
{p}p as (select extraction_id, page_no, any_value(n) as n, max(x) as top, list_sort(list(x)) as s from {p}v group by all),
{p}out as (select p.extraction_id, p.page_no, case when n < 10 then top * 1.2 when b.b.hi >= 2 * greatest(1, b.b.lo) then (b.b.hi + b.b.lo) / 2 else s[least(n - 1, floor(n * 0.9)::int)::int + 1] end as break_at, s[least(n - 1, floor(n * 0.9)::int)::int + 1] as p90 from {p}p p left join {p}b b on p.extraction_id = b.extraction_id and p.page_no = b.page_no)"""


@query(f"with {_sql_breaks(f'(select extraction_id, page_no, length(text)::double as x from {LINES} where text is not null)', 'j')} select extraction_id, page_no, round_even(break_at, 6) as break_at from jout")
def jenks_lengths(s, d):
    """Natural break of the line lengths of a page."""
    v = lines_of(s, d, PAGE_KEY).where("text is not null").select(*PAGE_KEY, F.length("text").alias("chars"))
    return cluster.natural_breaks(v, PAGE_KEY, "chars").select(*PAGE_KEY, r6(F.col("break_at")).alias("break_at"))


@query(f"""select extraction_id, page_no, det_idx, round_even(avg(confidence), 6) as mean_confidence, count(*) as blocks from (select * from ({_OV}) where overlap >= 0.5 and confidence between 0 and 1 qualify row_number() over (partition by extraction_id, page_no, block_idx order by overlap desc, det_idx) = 1) group by all having avg(confidence) >= 0.75""")
def confidence_gate(s, d):
    """Detections whose blocks are sure enough on average."""
    b = blocks_of(s, d, PAGE_KEY).where("confidence between 0 and 1")
    pairs = layout.assign(table(s, d, "detections").drop("confidence"), b)
    return cascade.gate(pairs, CascadeOptions()).select(*PAGE_KEY, "det_idx", r6(F.col("mean_confidence")).alias("mean_confidence"), "blocks")


@query("""select coalesce(lower(trim(label)), '') as label, count(*) as n, round_even(avg(confidence), 6) as mean_confidence, min(box.h) as least_height, max(box.w) as widest from detections group by 1""")
def class_diagnostics(s, d):
    """Detections by class."""
    return table(s, d, "detections").groupBy(F.coalesce(F.lower(F.trim("label")), F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_confidence"), F.min("box.h").alias("least_height"), F.max("box.w").alias("widest"))


@query(f"""select block_id, string_agg(trim(text, chr(32)), ' ' order by line_no, line_id) filter (regexp_matches(text, '\\S')) as text, round_even(coalesce(avg(score::double) filter (regexp_matches(text, '\\S')), 0), 6) as score from {LINES} where block_id in (select block_id from text_lines where regexp_matches(text, '\\S')) group by block_id""")
def joined_windows(s, d):
    """Texts and scores of a block's parts joined."""
    p = decode.join_parts(lines_of(s, d, BLOCK_KEY), ["block_id"], "line_no")
    return p.where("text <> ''").select("block_id", "text", r6(F.col("score")).alias("score"))


# -- text quality -----------------------------------------------------------------------------------------------------

_RUNS = f"""(select line_id, sum(n) as rep from (select line_id, count(*) as n from (select line_id, c, i - row_number() over (partition by line_id, c order by i) as g from (select line_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from {LINES} where length(text) > 0)) group by line_id, c, g having count(*) >= 3) group by line_id)"""


@query(f"""with q as (select l.line_id, length(text) as n, score, case when length(text) > 0 then length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) / length(text)::double else 1 end as up,
 case when length(text) > 0 then coalesce(rep, 0) / length(text)::double else 1 end as rp, case when length(text) > 0 then length(regexp_replace(text, '[^\\p{{Cc}}\\x{{FFFD}}]', '', 'g')) / length(text)::double else 1 end as np
 from {LINES} l left join {_RUNS} r on l.line_id = r.line_id where text is not null and score is not null)
select line_id, round_even(up, 6) as upper_ratio, round_even(rp, 6) as repeated_ratio, round_even(np, 6) as unprintable_ratio, round_even(least(greatest(score::double * (1 - (up + rp + np) / 3), 0), 1), 6) as confidence from q""")
def line_quality(s, d):
    """Penalties of every recognized line and its confidence."""
    t = F.col("text")
    up, rp, un = Q.upper_ratio(t), Q.repeated_ratio(t), Q.unprintable_ratio(t)
    return lines_of(s, d).where("text is not null and score is not null").select("line_id", r6(up).alias("upper_ratio"), r6(rp).alias("repeated_ratio"), r6(un).alias("unprintable_ratio"), r6(Q.line_confidence(F.col("score").cast("double"), up, rp, un)).alias("confidence"))


@query(f"""with q as (select block_id, count(*) as n, coalesce(sum(length(text)), 0) as c, coalesce(sum(length(regexp_replace(text, '\\P{{Lu}}', '', 'g'))), 0) as u from {LINES} group by block_id),
m as (select block_id, case when c = 0 then 1 else least(1, n / c::double) end as lc, case when c = 0 then 1 else u / c::double end as up from q) select block_id, round_even(lc, 6) as line_metric, round_even(up, 6) as upper_metric, round_even(least(greatest(1 - (lc + up) / 2, 0), 1), 6) as confidence from m""")
def block_quality(s, d):
    """Line-count and uppercase metrics of a block and its confidence."""
    c = F.coalesce(F.sum(F.length("text")), F.lit(0))
    g = lines_of(s, d, BLOCK_KEY).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), c.alias("c"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\p{Lu}"))), F.lit(0)).alias("u"))
    lc = Q.line_count_metric(F.col("n"), F.col("c"))
    up = F.when(F.col("c") == 0, F.lit(1.0)).otherwise(F.col("u") / F.col("c"))
    return g.select("block_id", r6(lc).alias("line_metric"), r6(up).alias("upper_metric"), r6(Q.block_confidence(lc, up)).alias("confidence"))


@query(f"""with w as (select extraction_id, page_no, text, box, row_number() over o as i, lead(box) over o as nx from {LINES} window o as (partition by extraction_id, page_no order by line_id)), f as (select * from w where i <= 50),
v as (select *, case when i < 50 and nx is not null then greatest(0, least(box.x + box.w, nx.x + nx.w) - greatest(box.x, nx.x)) * greatest(0, least(box.y + box.h, nx.y + nx.h) - greatest(box.y, nx.y)) else 0 end as inter from f),
g as (select extraction_id, page_no, sum(length(text)) as letters, sum(length(regexp_replace(text, '[^\\p{{Cc}}]', '', 'g'))) as controls, max(case when inter > 0 then inter / (box.w * box.h + nx.w * nx.h - inter) else 0 end) as worst from v group by all)
select extraction_id, page_no, letters::bigint as letters, controls::bigint as controls, round_even(worst, 6) as worst_overlap, coalesce(letters > 0 and controls <= 0.05 * letters and worst <= 0.3, false) as strong from g""")
def strong_text_gate(s, d):
    """Pages whose first fifty pieces look like text."""
    g = cascade.strong_text(lines_of(s, d, PAGE_KEY), ["line_id"])
    return g.select(*PAGE_KEY, F.col("letters").cast("bigint").alias("letters"), F.col("controls").cast("bigint").alias("controls"), r6(F.col("worst_overlap")).alias("worst_overlap"), "strong")


@query(f"""select block_id, regexp_replace(regexp_replace(string_agg(text, chr(10) order by line_no, line_id), '-\\n', '', 'g'), '\\n', ' ', 'g') as text from {LINES} where text is not null group by block_id""")
def accumulated_blocks(s, d):
    """Text of a block from its lines, hyphens at line ends dropped."""
    g = lines_of(s, d, BLOCK_KEY).where("text is not null").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))).alias("ls"))
    return g.select("block_id", Q.accumulate(F.transform("ls", lambda x: x["text"])).alias("text"))


@query("""select doc_id, len(l)::int as lines, coalesce(array_to_string(l, '|'), '') as text from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t, ' ')), lambda t: t <> '') as l from documents where text is not null)""")
def split_to_lines(s, d):
    """Trimmed non-empty lines of every document."""
    l = Q.text_lines(F.col("text"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(l).alias("lines"), F.array_join(l, "|").alias("text"))


# -- order ------------------------------------------------------------------------------------------------------------


def _sql_order(src: str) -> str:
    """Blocks with band and reading_no: greedy bands; a block without height is one by itself."""
    return f"""(select *, (row_number() over (partition by extraction_id, page_no order by band, box.x, box.y, block_idx) - 1)::int as reading_no from (select *, (dense_rank() over (partition by extraction_id, page_no order by seed.y, seed.i) - 1)::int as band
 from (select *, case when tall then last_value(case when tall and (m is null or box.y >= m) then {{'y': box.y, 'i': block_idx}} end ignore nulls) over (partition by extraction_id, page_no order by box.y, block_idx rows unbounded preceding) else {{'y': box.y, 'i': block_idx}} end as seed
 from (select *, coalesce(box.h > 0, false) as tall, max(case when box.h > 0 then box.y + box.h end) over (partition by extraction_id, page_no order by box.y, block_idx rows between unbounded preceding and 1 preceding) as m from {src}))))"""


@query(f"select extraction_id, page_no, block_idx, band, reading_no from {_sql_order(BLOCKS)}")
def reading_order(s, d):
    """Bands of blocks from top to bottom, inside a band from left to right."""
    return order.reading_order(blocks_of(s, d, PAGE_KEY)).select(*PAGE_KEY, "block_idx", "band", "reading_no")


@query(f"""with w as (select extraction_id, page_no, list({{'o': (box.y + box.h), 'i': line_id, 'l': box.x, 'h': box.h}} order by box.y + box.h, line_id) as ws from {LINES} where text is not null group by all),
f as (select extraction_id, page_no, unnest(list_reduce(ws, lambda a, x: case when a.n = 0 or abs(-x.o - a.mean) > a.tol then {{'mean': -x.o, 'n': 1, 'tol': x.h * 0.5, 'line': a.line + 1, 'out': list_append(a.out, {{'line': a.line + 1, 'i': x.i, 'l': x.l}})}}
 else {{'mean': a.mean + (-x.o - a.mean) / (a.n + 1), 'n': a.n + 1, 'tol': a.tol, 'line': a.line, 'out': list_append(a.out, {{'line': a.line, 'i': x.i, 'l': x.l}})}} end, {{'mean': 0.0::double, 'n': 0::int, 'tol': 0.0::double, 'line': -1::int, 'out': [{{'line': 0::int, 'i': 0::bigint, 'l': 0.0::double}}][1:0]}}).out) as r from w)
select extraction_id, page_no, r.line as line_no, string_agg(r.i::varchar, ' ' order by r.l, r.i) as pieces from f group by all""")
def built_lines(s, d):
    """Pieces of a page gathered to lines by the running mean of their bottoms."""
    w = lines_of(s, d, PAGE_KEY).where("text is not null").select(*PAGE_KEY, F.col("line_id").alias("word_idx"), (-(F.col("box.y") + F.col("box.h"))).alias("bottom"), F.col("box.x").alias("left"), F.col("box.h").alias("height"), F.col("line_id").cast("string").alias("text"))
    return order.line_texts(order.build_lines(w)).select(*PAGE_KEY, "line_no", F.col("text").alias("pieces"))


_PEAK = "len({0}s) >= 3 and ({0} < {0}s[floor(len({0}s) * 0.25)::int + 1] - greatest(1.5 * ({0}s[floor(len({0}s) * 0.75)::int + 1] - {0}s[floor(len({0}s) * 0.25)::int + 1]), 5) or {0} > {0}s[floor(len({0}s) * 0.75)::int + 1] + greatest(1.5 * ({0}s[floor(len({0}s) * 0.75)::int + 1] - {0}s[floor(len({0}s) * 0.25)::int + 1]), 5))"


@query(f"""with l as (select *, row_number() over o as i, coalesce(abs(box.y - lag(box.y) over o), 0) as g, box.x as lf, box.x + box.w as rt from {LINES} window o as (partition by block_id order by line_no)),
a as (select *, list_sort(list(g) over w) as gs, list_sort(list(lf) over w) as lfs, list_sort(list(rt) over w) as rts from l window w as (partition by block_id)),
p as (select *, {_PEAK.format('g')} as pg, {_PEAK.format('lf')} as pl, {_PEAK.format('rt')} as pr from a), b as (select *, i > 1 and (pg or (pl and coalesce(lag(pr) over (partition by block_id order by line_no), false))) as brk from p)
select line_id, block_id, sum(brk::int) over (partition by block_id order by line_no rows unbounded preceding)::int as paragraph from b""")
def paragraphs(s, d):
    """Paragraphs of a block by unusual gaps and indents."""
    return order.split_paragraphs(lines_of(s, d, BLOCK_KEY)).select("line_id", "block_id", "paragraph")


def lines_by_block(s, d) -> DataFrame:
    """(block_id, lines): the lines of every block in order, with their boxes; lines without text leave."""
    l = lines_of(s, d, BLOCK_KEY).where("text is not null and block_id is not null")
    return l.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", F.struct("text", "box").alias("l")))), lambda x: x["l"]).alias("lines"))


def blocks_with_lines(s, d) -> DataFrame:
    """Every block, with its lines; those without have none."""
    b = blocks_of(s, d).drop("text").withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))
    return b.join(lines_by_block(s, d), "block_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(f"array<{LINE}>")))


_LAST = r"regexp_replace(a[-1].ls[-1].t, '[\s\x{A0}]+$', '')"
_FIRST = r"regexp_replace(x.ls[1].t, '^[\s\x{A0}]+', '')"
_LH = "((list_sum(list_filter(list_transform(list_concat(a[-1].ls, x.ls), lambda k: k.h), lambda h: h > 0))) / nullif(len(list_filter(list_concat(a[-1].ls, x.ls), lambda k: k.h > 0)), 0))"
_MERGED = rf"""m0 as (select block_id, list({{'t': text, 'h': box.h}} order by line_no, line_id) as ls from {LINES} where text is not null and block_id is not null group by 1),
m1 as (select b.* exclude (confidence), case when not isnan(b.confidence) then b.confidence end as confidence, coalesce(m0.ls, [{{'t': '', 'h': 0.0::double}}][1:0]) as ls from {BLOCKS} b left join m0 on b.block_id = m0.block_id),
m2 as (select extraction_id, page_no, list({{'label': label, 'c': confidence, 'x': box.x, 'y': box.y, 'w': box.w, 'h': box.h, 'ls': ls, 'n': 1::int}} order by reading_no) as bs from {_sql_order('m1')} group by all),
m3 as (select extraction_id, page_no, list_reduce(bs, lambda a, x: case when coalesce(len(a) > 0 and a[-1].label = 'Text' and x.label = 'Text' and len(a[-1].ls) > 0 and len(x.ls) > 0 and greatest(least(a[-1].x + a[-1].w, x.x + x.w) - greatest(a[-1].x, x.x), 0) / nullif(least(a[-1].w, x.w), 0) >= 0.5
 and {_LH} > 0 and x.y - (a[-1].y + a[-1].h) >= -1.0 * {_LH} and x.y - (a[-1].y + a[-1].h) <= 1.5 * {_LH} and ({_LAST} like '%-' or (length({_LAST}) > 0 and not regexp_matches({_LAST}, '[.!?:;]$') and regexp_matches({_FIRST}, '^\p{{Ll}}'))), false)
 then list_append(a[1:-2], {{'label': a[-1].label, 'c': (a[-1].c + x.c) / 2, 'x': least(a[-1].x, x.x), 'y': least(a[-1].y, x.y), 'w': greatest(a[-1].x + a[-1].w, x.x + x.w) - least(a[-1].x, x.x), 'h': greatest(a[-1].y + a[-1].h, x.y + x.h) - least(a[-1].y, x.y),
  'ls': case when {_LAST} like '%-' then list_concat(list_append(a[-1].ls[1:-2], {{'t': left({_LAST}, length({_LAST}) - 1) || {_FIRST}, 'h': a[-1].ls[-1].h}}), x.ls[2:]) else list_concat(a[-1].ls, x.ls) end, 'n': a[-1].n + 1}})
 else list_append(a, x) end, bs[1:0]) as r from m2), m4 as (select extraction_id, page_no, unnest(r) as m, generate_subscripts(r, 1) - 1 as merged_no from m3)"""


@query(f"""with {_MERGED} select extraction_id, page_no, merged_no::int as merged_no, m.label as label, m.n as blocks, len(m.ls)::int as lines, round_even(m.c, 6) as confidence, round_even(m.h, 6) as height, array_to_string(list_transform(m.ls, lambda k: k.t), chr(10)) as text from m4""")
def merged_paragraphs(s, d):
    """Blocks that go on the paragraph before them joined to it, in reading order; all blocks count."""
    m = order.merge_paragraphs(order.reading_order(blocks_with_lines(s, d)))
    return m.select(*PAGE_KEY, "merged_no", "label", "blocks", F.size("lines").alias("lines"), r6(F.col("confidence")).alias("confidence"), r6(F.col("box.h")).alias("height"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def _intervals(s, d):
    """Interval rows: the lines' boxes."""
    return lines_of(s, d, PAGE_KEY).select(*PAGE_KEY, "line_id", F.col("box.y").cast("int").alias("top"), (F.col("box.y") + F.col("box.h")).cast("int").alias("bottom"), F.col("box.x").cast("int").alias("left"), (F.col("box.x") + F.col("box.w")).cast("int").alias("right"))


_INT = f"(select extraction_id, page_no, line_id, trunc(box.y)::int as top, trunc(box.y + box.h)::int as bottom, trunc(box.x)::int as lft, trunc(box.x + box.w)::int as rgt from {LINES})"


@query(f"""with i as (select *, max(bottom) over (partition by extraction_id, page_no order by top, bottom rows between unbounded preceding and 1 preceding) as m from {_INT}),
g as (select *, sum(case when m is null or top > m then 1 else 0 end) over (partition by extraction_id, page_no order by top, bottom rows unbounded preceding) - 1 as strip from i)
select extraction_id, page_no, strip::int as strip, greatest(min(top) - 4, 0) as top, max(bottom) as bottom, count(*) as components from g group by extraction_id, page_no, strip""")
def line_strips(s, d):
    """Full-width strips of touching components."""
    return order.line_strips(_intervals(s, d), PAGE_KEY)


@query(f"""with i as (select *, max(rgt) over (partition by extraction_id, page_no order by lft, rgt rows between unbounded preceding and 1 preceding) as m from {_INT}),
g as (select *, sum(case when m is null or lft > m + 2 then 1 else 0 end) over (partition by extraction_id, page_no order by lft, rgt rows unbounded preceding) - 1 as span from i)
select extraction_id, page_no, span::int as span, min(lft) as lft, max(rgt) as rgt, count(*) as parts from g group by extraction_id, page_no, span""")
def merged_spans(s, d):
    """Horizontal spans that meet within two pixels."""
    return order.merge_spans(_intervals(s, d), PAGE_KEY).withColumnsRenamed({"left": "lft", "right": "rgt"})


def _segments(s, d):
    return lines_of(s, d).where("text is not null").select("block_id", F.posexplode(F.split("text", " ")).alias("i", "w"), "line_no", "line_id").select("block_id", "line_no", "line_id", (F.col("i") * 120).alias("start"), (F.col("i") * 120 + F.length("w") * 12).alias("end"))


@query(f"""with s as (select line_id, (i - 1) * 120 as st, (i - 1) * 120 + length(w) * 12 as en from (select line_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from {LINES} where text is not null)),
g as (select line_id, list({{'s': st::int, 'e': en::int}} order by st, en) as l from s group by line_id), f as (select line_id, list_reduce(l, lambda a, x: case when len(a) > 0 and x.e - a[-1].s + 1 <= 600 then list_append(a[1:-2], {{'s': a[-1].s, 'e': x.e}}) else list_append(a, x) end, l[1:0]) as r from g)
select line_id, (generate_subscripts(r, 1) - 1)::int as window_no, unnest(r).s as st, unnest(r).e as en from f""")
def packed_windows(s, d):
    """Segments of every line packed into windows of at most 600 pixels."""
    return order.pack_windows(_segments(s, d), ["line_id"]).withColumnsRenamed({"start": "st", "end": "en"})


def _spans(s, d):
    return lines_of(s, d, BLOCK_KEY).select("block_id", "line_no", (F.col("box.y")).cast("int").alias("left"), (F.col("box.y") + F.col("box.h") / 2 + F.col("box.w") % 7 / 2).cast("int").alias("right"), "line_id").drop("line_no", "line_id").distinct()


_SP = f"""sp as (select distinct block_id, trunc(box.y)::int as lft, trunc(box.y + box.h / 2 + box.w % 7 / 2)::int as rgt from {LINES}), ga as (select *, (row_number() over o - 1)::int as span_no, greatest(lft - lag(rgt) over o, 0) as gap from sp window o as (partition by block_id order by lft, rgt))"""
_OTSU = """tt as (select ga.block_id, u.t, count(gap) filter (gap <= t) as k, count(gap) as n, sum(gap) filter (gap <= t)::double as s, sum(gap)::double as a from ga join (select distinct block_id, gap as t from ga where gap is not null) u on ga.block_id = u.block_id where gap is not null group by ga.block_id, u.t),
oo as (select block_id, case when max(t) <= 0 or max(g) <= 0 then 0 else arg_max(t, {'g': g, 't': -t}) end as lim from (select *, case when k > 0 and k < n then k::double * (n - k) * power(s / k - (a - s) / (n - k), 2) else 0 end as g from tt) group by block_id)"""


@query(f"""with {_SP}, {_OTSU}, st as (select block_id, max(gap) >= 2 * greatest(1, min(gap)) as clear from ga where gap is not null group by block_id)
select ga.block_id, span_no, sum(case when coalesce(clear, false) and coalesce(gap > lim, false) then 1 else 0 end) over (partition by ga.block_id order by span_no rows unbounded preceding)::int as word from ga left join oo on ga.block_id = oo.block_id left join st on ga.block_id = st.block_id""")
def word_boundaries_cca(s, d):
    """Words from gaps over Otsu's threshold."""
    return words.boundaries(words.segment_gaps(_spans(s, d), ["block_id"]), ["block_id"], "cca").select("block_id", "span_no", "word")


@query(f"""with {_SP}, mm as (select block_id, round_even(avg(gap), 0) as lim from ga where gap is not null group by block_id), st as (select ga.block_id, max(gap) >= 2 * greatest(1, min(gap)) and coalesce(avg(gap) filter (gap > lim) >= 2 * avg(gap) filter (gap <= lim), false) as clear from ga join mm on ga.block_id = mm.block_id where gap is not null group by ga.block_id)
select ga.block_id, span_no, sum(case when coalesce(clear, false) and coalesce(gap > lim, false) then 1 else 0 end) over (partition by ga.block_id order by span_no rows unbounded preceding)::int as word from ga left join mm on ga.block_id = mm.block_id left join st on ga.block_id = st.block_id""")
def word_boundaries_rlsa(s, d):
    """Words from gaps over the rounded mean."""
    return words.boundaries(words.segment_gaps(_spans(s, d), ["block_id"]), ["block_id"], "rlsa").select("block_id", "span_no", "word")


@query(f"""select line_id, block_id, floor((row_number() over (partition by extraction_id, page_no order by box.w, line_id) - 1) / 32)::int as batch from {LINES}""")
def width_batches(s, d):
    """Recognizer batches of similar width."""
    return order.width_batches(lines_of(s, d, PAGE_KEY), PAGE_KEY, F.col("box.w"), "line_id").select("line_id", "block_id", "batch")


@query(f"""with {_SP}, {_OTSU} select ga.block_id, span_no, sum(case when lft % 3 <> 0 and coalesce(gap > lim, false) then 1 else 0 end) over (partition by ga.block_id order by span_no rows unbounded preceding)::int as word from ga left join oo on ga.block_id = oo.block_id""")
def word_boundaries_aom(s, d):
    """Words from gaps that are deep and over Otsu's threshold."""
    return words.boundaries(words.segment_gaps(_spans(s, d), ["block_id"]), ["block_id"], "aom", F.col("left") % 3 != 0).select("block_id", "span_no", "word")


_CHARS = f"(select line_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) - 1 as pos from {LINES} where length(text) > 0)"


@query(f"""with i as (select *, pos - lag(pos) over (partition by line_id order by pos) as step from {_CHARS} where c not in (' ', '.', ',', '-')), g as (select *, sum(case when step is null or step > 2 then 1 else 0 end) over (partition by line_id order by pos rows unbounded preceding) - 1 as run from i)
select line_id, run::int as run, min(pos)::int as st, max(pos)::int as en from g group by line_id, run""")
def ink_runs(s, d):
    """Runs of inked columns of a line; two empty ones end a run."""
    c = lines_of(s, d).where("length(text) > 0").select("line_id", F.posexplode(F.split("text", "")).alias("pos", "c")).where("c <> ''")
    return order.runs(c, ["line_id"], "pos", ~F.col("c").isin(" ", ".", ",", "-"), 2).withColumnsRenamed({"start": "st", "end": "en"})


@query(f"""with p as (select extraction_id, page_no, unnest(range(0, 600, 1))::int as x from (select distinct extraction_id, page_no from text_lines)), l as {LINES},
n as (select p.extraction_id, p.page_no, x, count(l.line_id) as n from p left join l on p.extraction_id = l.extraction_id and p.page_no = l.page_no and l.box.x + l.line_no % 2 * 250 <= x and x < l.box.x + l.line_no % 2 * 250 + l.box.w / 4 group by all),
h as (select extraction_id, page_no, count(*) as h from l group by all), o as (select n.*, h, x - lag(x) over (partition by n.extraction_id, n.page_no order by x) as step from n join h on n.extraction_id = h.extraction_id and n.page_no = h.page_no where n <= h * 0.05::double),
g as (select *, sum(case when step is null or step > 1 then 1 else 0 end) over (partition by extraction_id, page_no order by x rows unbounded preceding) as r from o)
select extraction_id, page_no, st, en from (select extraction_id, page_no, r, min(x) as st, max(x) as en from g group by all) where en - st + 1 >= 12 and st > 60 and en < 540""")
def page_column_gaps(s, d):
    """Gaps between columns of a page from the cover of its lines (shifted and shortened so that there are some)."""
    l = lines_of(s, d)
    n = l.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("h"))
    x0 = F.col("box.x") + F.col("line_no") % 2 * 250
    x1 = F.least(F.ceil(x0 + F.col("box.w") / 4) - 1, F.lit(599))
    cover = l.where(x1 >= F.ceil(x0)).select(*PAGE_KEY, F.explode(F.sequence(F.ceil(x0).cast("int"), x1.cast("int"))).alias("x")).groupBy(*PAGE_KEY, "x").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select(*PAGE_KEY, "h", F.explode(F.sequence(F.lit(0), F.lit(599))).alias("x"))
    prof = grid.join(cover, [*PAGE_KEY, "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return order.column_gaps(prof, PAGE_KEY, "x", "n", F.col("h"), F.lit(600)).withColumnsRenamed({"start": "st", "end": "en"})


@query(f"""select line_id, (row_number() over (partition by block_id order by box.y, box.x, line_id) - 1)::int as component_no from {LINES} qualify row_number() over (partition by block_id order by line_id) <= 5""")
def component_order(s, d):
    """The first five pieces of a block, numbered from the top."""
    l = order.component_order(lines_of(s, d, BLOCK_KEY), ["block_id"], "line_id")
    return order.first_rows(l, ["block_id"], ["line_id"], 5).select("line_id", "component_no")


@query(f"""with f as (select *, trunc(box.w * box.h / 4)::int as area from {LINES} where trunc(box.w * box.h / 4)::int <= least(50000, 600 * 850 / 2.0) and greatest(box.w, box.h) <= 30 * greatest(least(box.w, box.h), 1)),
h as (select *, list_sort(list(box.h) over (partition by extraction_id, page_no)) as s from f), m as (select *, s[floor(len(s) / 4)::int + 1 : floor(len(s) * 3 / 4)::int] as mid from h)
select line_id, area, box.h >= greatest(2, floor(12 / 6.0)) and area >= 4 as letter from m where area >= case when len(mid) = 0 then 4 else greatest(4, floor(power(list_sum(mid) / len(mid) * 0.25, 2))::int) end""")
def component_filters(s, d):
    """Components of text size, and whether they may be letters of a line."""
    p = lines_of(s, d, PAGE_KEY).withColumn("area", (F.col("box.w") * F.col("box.h") / 4).cast("int"))
    kept = layout.text_components(p, PAGE_KEY, F.lit(600), F.lit(850))
    letters = layout.line_components(kept, F.lit(12)).select("line_id", F.lit(True).alias("letter"))
    return kept.join(letters, "line_id", "left").select("line_id", "area", F.coalesce("letter", F.lit(False)).alias("letter"))


@query(f"""with recursive n as materialized (select *, ang <= 40 or ang >= 140 as flat from ({_KNN}) qualify row_number() over (partition by extraction_id, page_no, a order by dist, b) <= 10),
{_sql_breaks('(select extraction_id, page_no, dist as x from n where flat)', 'f')}, {_sql_breaks('(select extraction_id, page_no, dist as x from n where not flat)', 'd')},
l as (select h.extraction_id, h.page_no, case when fout.p90 > 0 then fout.p90 else hh * 1.5 end as th, case when dout.break_at > 0 then dout.break_at else hh * 2 end as tv from (select extraction_id, page_no, avg(box.h) as hh from {LINES} group by all) h
 left join fout on h.extraction_id = fout.extraction_id and h.page_no = fout.page_no left join dout on h.extraction_id = dout.extraction_id and h.page_no = dout.page_no),
e as (select n.extraction_id, n.page_no, a, b from n join l on n.extraction_id = l.extraction_id and n.page_no = l.page_no where flat and dist <= th or not flat and dist <= tv and ba.x <= bb.x + bb.w and bb.x <= ba.x + ba.w),
u as (select extraction_id, page_no, a, b from e union select extraction_id, page_no, b, a from e),
r as (select extraction_id, page_no, line_id as a, line_id as root from {LINES} union select u.extraction_id, u.page_no, u.b, r.root from r join u on r.extraction_id = u.extraction_id and r.page_no = u.page_no and r.a = u.a)
select extraction_id, page_no, a as line_id, min(root) as cluster from r group by all""")
def component_clusters(s, d):
    """Connected groups of components by percentile and natural-break thresholds."""
    l = lines_of(s, d)
    return cluster.groups(l, cluster.component_edges(l, PAGE_KEY, "line_id"), PAGE_KEY, "line_id")


@query(f"""with i as (select extraction_id, page_no, trunc(box.y)::int as top, trunc(box.y + box.h)::int as bottom from {LINES} where trunc(box.y + box.h)::int - trunc(box.y)::int >= 3 and trunc(box.x + box.w)::int - trunc(box.x)::int >= 2),
m as (select *, max(bottom) over (partition by extraction_id, page_no order by top, bottom rows between unbounded preceding and 1 preceding) as m from i), g as (select *, sum(case when m is null or top > m then 1 else 0 end) over (partition by extraction_id, page_no order by top, bottom rows unbounded preceding) as strip from m)
select extraction_id, page_no, greatest(min(top) - 4, 0) as top, max(bottom) as bottom from g group by extraction_id, page_no, strip""")
def raster_strips(s, d):
    """Text strips found by the pixel kernel in pages drawn from the lines' boxes."""
    import numpy as np
    import pandas as pd

    from ..operators import raster

    boxes = lines_of(s, d, PAGE_KEY).groupBy(*PAGE_KEY).agg(F.collect_list("box").alias("boxes"))

    def draw(batches):
        for b in batches:
            out = []
            for e, p, bs in zip(b["extraction_id"], b["page_no"], b["boxes"]):
                rects = [(int(x["x"]), int(x["y"]), int(x["x"] + x["w"]), int(x["y"] + x["h"])) for x in bs]
                img = np.full((max(r[3] for r in rects) + 1, max(r[2] for r in rects) + 1), 255, np.uint8)
                for l, t, r, q in rects:
                    img[t:q, l:r] = 0
                out += [(e, p, t, q) for t, q in raster.line_strips(img)]
            yield pd.DataFrame(out, columns=["extraction_id", "page_no", "top", "bottom"])

    return boxes.mapInPandas(draw, "extraction_id bigint, page_no int, top int, bottom int")


_ANCH = "(select extraction_id, page_no, det_idx, (box.x + box.w / 2) * 0.5 + 20 as cx, (box.y + box.h / 2) * 0.5 as cy, box.w * 0.5 as w, box.h * 0.5 as h, det_idx % 11 as k, confidence as p from detections)"


@query(f"""with c as (select *, least(greatest(cx - w / 2, 0), 640) as x0, least(greatest(cy - h / 2, 0), 640) as y0, least(greatest(cx + w / 2, 0), 640) as x1, least(greatest(cy + h / 2, 0), 640) as y1 from {_ANCH} where p >= 0.25),
u as (select *, least(greatest((x0 - 20) / 0.5, 0), 1200) as a, least(greatest(y0 / 0.5, 0), 1280) as b, least(greatest((x1 - 20) / 0.5, 0), 1200) as c, least(greatest(y1 / 0.5, 0), 1280) as e from c)
select extraction_id, page_no, det_idx, k::int as class_idx, ['{"','".join(LABELS)}'][k + 1] as label, {sql_flat('a', 'b', 'u.c - a', 'e - b')} from u where u.c - a > 0 and e - b > 0""")
def decoded_anchors(s, d):
    """Anchors made from the detections decoded back to image boxes."""
    c = F.col
    rows = table(s, d, "detections").select(*PAGE_KEY, c("det_idx").alias("anchor"), ((c("box.x") + c("box.w") / 2) * 0.5 + 20).alias("cx"), ((c("box.y") + c("box.h") / 2) * 0.5).alias("cy"), (c("box.w") * 0.5).alias("w"), (c("box.h") * 0.5).alias("h"),
        F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.when(k == c("det_idx") % 11, c("confidence")).otherwise(c("confidence") / 2)).alias("scores"), F.lit(0.5).alias("scale"), F.lit(20.0).alias("pad_x"), F.lit(0.0).alias("pad_y"), F.lit(1200).alias("img_w"), F.lit(1280).alias("img_h"))
    return layout.decode_anchors(rows).select(*PAGE_KEY, "det_idx", "class_idx", "label", *flat(c("box")))


@query(f"""select extraction_id, page_no, det_idx, case when class_idx between 0 and 10 then ['{"','".join(LABELS)}'][class_idx + 1] else 'Unknown' end as label, -1 as class_idx, {sql_flat('box.x / 600 * 640', 'box.y / 900 * 640', '((box.x + box.w) / 600 - box.x / 600) * 640', '((box.y + box.h) / 900 - box.y / 900) * 640')} from detections where confidence >= 0.5""")
def decoded_corners(s, d):
    """Normalised corners made from the detections decoded to the model square."""
    c = F.col
    rows = table(s, d, "detections").select(*PAGE_KEY, c("det_idx").alias("anchor"), (c("box.x") / 600).alias("x0"), (c("box.y") / 900).alias("y0"), ((c("box.x") + c("box.w")) / 600).alias("x1"), ((c("box.y") + c("box.h")) / 900).alias("y1"), "class_idx", "confidence")
    return layout.decode_corners(rows).select(*PAGE_KEY, "det_idx", "label", "class_idx", *flat(c("box")))


@query("""select doc_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%fZ') as ingested_utc, strftime(processed_at, '%Y-%m-%dT%H:%M:%S.%fZ') as processed_utc from documents""")
def utc_strings(s, d):
    """Times as ISO strings in UTC."""
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    utc = lambda c: F.date_format(F.convert_timezone(F.lit(s.conf.get("spark.sql.session.timeZone")), F.lit("UTC"), F.col(c).cast("timestamp_ntz")), fmt)
    return table(s, d, "documents").select("doc_id", utc("ingested_at").alias("ingested_utc"), utc("processed_at").alias("processed_utc"))


@query("""select input_file, count(*) as batches, count(distinct page_no) as pages, sum(w)::bigint as width_sum, round_even(avg(w), 6) as mean_width, round_even(100.0::double * count(*) / sum(count(*)) over (), 6) as share from (select distinct on (line_id) line_id, input_file, page_no, trunc(box.w)::bigint as w from text_lines order by line_id) group by input_file""")
def recognition_profile(s, d):
    """Counters of a recognition run by input: lines, pages, widths and shares."""
    p = lines_of(s, d).select("input_file", "page_no", F.col("box.w").cast("bigint").alias("w")).groupBy("input_file").agg(F.count(F.lit(1)).alias("batches"), F.count_distinct("page_no").alias("pages"), F.sum("w").alias("width_sum"), F.avg("w").alias("m"))
    total = F.sum("batches").over(Window.partitionBy())  # one row per input
    return p.select("input_file", "batches", "pages", "width_sum", r6(F.col("m")).alias("mean_width"), r6(F.lit(100.0) * F.col("batches") / total).alias("share"))


# -- decoding ---------------------------------------------------------------------------------------------------------

SYMBOLS = [chr(97 + i) for i in range(26)]
_STEPS = """st as (select vec_id // 20 as seq, vec_id % 20 as t, list_position(embedding, list_max(embedding)) - 1 as c, list_max(embedding)::double as p from embeddings)"""
_SYM = "['" + "','".join(SYMBOLS) + "']"


def _steps(s, d):
    return table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("seq"), (F.col("vec_id") % 20).alias("t"), "embedding")


@query(f"""with {_STEPS}, e as (select *, c <> 0 and coalesce(lag(c) over (partition by seq order by t) <> c, true) as emit from st)
select seq, coalesce(string_agg(case when c <= 26 then {_SYM}[c] else '' end, '' order by t) filter (emit), '') as text, round_even(coalesce(avg(p) filter (emit), 0), 6) as score from e group by seq""")
def ctc_decode(s, d):
    """Greedy timestep decoding."""
    return decode.ctc(_steps(s, d), ["seq"], "t", "embedding", SYMBOLS).select("seq", "text", r6(F.col("score")).alias("score"))


def _sparse(s, d):
    """Timesteps with many blanks, so that runs of them occur."""
    c = F.when(F.col("vec_id") % 3 != 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), *[(F.col("label") % 3 == k).cast("double") for k in range(3)]))
    return table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("seq"), (F.col("vec_id") % 20).alias("t"), c.alias("embedding"))


@query(f"""with st as (select vec_id // 20 as seq, vec_id % 20 as t, case when vec_id % 3 <> 0 then 0 else label % 3 + 1 end::int as c from embeddings), g as (select seq, list({{'c': c, 's': case when c > 0 then {_SYM}[c] else '' end}} order by t) as l from st group by seq)
select seq, list_reduce(l, lambda a, x: case when x.c = 0 then {{'t': a.t, 'r': a.r + 1, 'k': 0}} else {{'t': case when x.c = a.k then a.t else a.t || (case when a.r >= 2 and a.t <> '' and not a.t like '% ' then ' ' else '' end) || x.s end, 'r': 0, 'k': x.c}} end, {{'t': '', 'r': 0::int, 'k': 0::int}}).t as text from g""")
def ctc_decode_spaces(s, d):
    """Timestep decoding with spaces at runs of blanks."""
    return decode.ctc_spaced(_sparse(s, d), ["seq"], "t", "embedding", SYMBOLS, 2)


@query(f"""select label, array_to_string(list_transform(list_filter(list(label + vec_id % 30 order by vec_id), lambda i: i >= 0 and i < 26), lambda i: {_SYM}[i + 1]), '') as text from embeddings group by label""")
def index_decode(s, d):
    """Index sequences to symbols; indexes outside leave."""
    g = table(s, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", (F.col("label") + F.col("vec_id") % 30).cast("int").alias("i")))).alias("l"))
    return g.select("label", decode.indexes_to_text(F.transform("l", lambda x: x["i"]), SYMBOLS).alias("text"))


@query(f"""with g as (select block_id, list(box.w order by line_no, line_id) as ws from {LINES} where block_id is not null group by 1), t as (select b.block_id, b.text, length(b.text) as n, ws, list_sum(ws) as tw from {BLOCKS} b join g on b.block_id = g.block_id where b.text is not null),
s as (select block_id, n, i, ws[i] / tw * n as q from (select *, unnest(range(1, len(ws) + 1)) as i from t where n > 0 and len(ws) > 1 and tw > 0)), c as (select *, greatest(1, trunc(q)::int) as c from s), r as (select *, q - c as r, n - sum(c) over (partition by block_id) as extra from c),
up as (select block_id, i from r where extra > 0 qualify row_number() over (partition by block_id order by r desc, i) <= extra), dn as (select block_id, i, count(*) as m from (select block_id, i from (select *, unnest(range(0, c - 1)) as k from r where extra < 0) qualify row_number() over (partition by block_id order by r + k, i) <= -extra) group by all),
f as (select r.block_id, r.i, r.n, c + case when up.i is not null then 1 else 0 end - coalesce(dn.m, 0) as c from r left join up on r.block_id = up.block_id and r.i = up.i left join dn on r.block_id = dn.block_id and r.i = dn.i),
p as (select *, sum(c) over (partition by block_id order by i) - c as pos from f), j as (select p.block_id, string_agg(substr(t.text, pos::int + 1, c::int), ' ' order by p.i) as text from p join t on p.block_id = t.block_id where pos < p.n group by 1)
select t.block_id, coalesce(j.text, t.text) as text from t left join j on t.block_id = j.block_id""")
def distributed_chars(s, d):
    """Characters of a block's text shared out over the widths of its lines."""
    g = lines_of(s, d, BLOCK_KEY).groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "box"))), lambda x: x["box"]["w"]).alias("ws"))
    b = blocks_of(s, d, BLOCK_KEY).where("text is not null").select("block_id", "text")
    return b.join(g, "block_id").select("block_id", decode.shared_out(F.col("text"), F.col("ws")).alias("text"))


# -- sources, sinks, whole ----------------------------------------------------------------------------------------------

_EX = "(select distinct input_file as path from extractions where input_file is not null)"


@query(rf"""select path, regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1) as stem, lower(regexp_extract(path, '\.([^./]*)$', 1)) as ext, regexp_replace(path, '/?[^/]*$', '') as folder,
 case when lower(regexp_extract(path, '\.([^./]*)$', 1)) = 'pdf' then 'pdf' when lower(regexp_extract(path, '\.([^./]*)$', 1)) in ('png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff') then 'image' else 'unsupported' end as format from {_EX}""")
def input_formats(s, d):
    """Path parts and format of every input."""
    p = table(s, d, "extractions").select(F.col("input_file").alias("path")).where("path is not null").distinct()
    c = F.col("path")
    return files.with_format(p).select("path", files.stem(c).alias("stem"), files.extension(c).alias("ext"), files.folder(c).alias("folder"), "format")


@query("""select input_file, extraction_id from (select distinct extraction_id, input_file from extractions where input_file is not null) qualify row_number() over (partition by lower(input_file) order by extraction_id, input_file) = 1""")
def distinct_inputs(s, d):
    """Inputs without repeats, whatever the case of their path; the first stays."""
    e = table(s, d, "extractions").select("extraction_id", "input_file").where("input_file is not null").distinct()
    return files.first_of_each(e.withColumn("ord", F.struct("extraction_id", "input_file")), "input_file", "ord").select("input_file", "extraction_id")


@query("""select extraction_id, page_no, round_even(case when pdf_w_pt > 0 then least(greatest(2480 / pdf_w_pt, 1), 300 / 72.0::double) else 300 / 72.0::double end, 9) as scale from page_info""")
def pdf_scales(s, d):
    """Raster scale of every page."""
    return table(s, d, "page_info").select(*PAGE_KEY, F.bround(files.pdf_scale(F.col("pdf_w_pt")), 9).alias("scale"))


@query("""with b as """ + BLOCKS + """, n as (select extraction_id, count(*) as blocks, round_even(sum(case when confidence between 0 and 1 then round(confidence * 10000)::bigint end)::double / count(case when confidence between 0 and 1 then 1 end) / 10000, 6) as confidence from b group by 1),
e as (select extraction_id, max(case when not isnan(elapsed_seconds) then elapsed_seconds end) as s, count(*) as records from extractions group by 1) select e.extraction_id, coalesce(blocks, 0) as block_count, round_even(s, 2) as elapsed_seconds, confidence, records from e left join n on e.extraction_id = n.extraction_id""")
def extraction_headers(s, d):
    """Block count, rounded seconds and confidence of every extraction."""
    b = blocks_of(s, d)
    ok = F.col("confidence").between(0, 1)
    n = b.groupBy("extraction_id").agg(F.count(F.lit(1)).alias("blocks"), F.bround(F.sum(F.when(ok, F.round(F.col("confidence") * 10000).cast("bigint"))).cast("double") / F.count(F.when(ok, 1)) / 10000, 6).alias("confidence"))
    e = table(s, d, "extractions").groupBy("extraction_id").agg(F.max(F.when(~F.isnan("elapsed_seconds"), F.col("elapsed_seconds"))).alias("s"), F.count(F.lit(1)).alias("records"))
    return e.join(n, "extraction_id", "left").select("extraction_id", F.coalesce("blocks", F.lit(0)).alias("block_count"), sinks.rounded(F.col("s"), 2).alias("elapsed_seconds"), "confidence", "records")


def _headed(s, d) -> DataFrame:
    """Every block with its lines under the header of its extraction; extractions without blocks come with none."""
    e = table(s, d, "extractions").groupBy("extraction_id").agg(F.max_by("input_file", "received_at").alias("input_file"), F.max_by("processed_at", "received_at").alias("processed_at"), F.max_by("elapsed_seconds", "received_at").alias("seconds"))
    return e.where("extraction_id is not null").join(blocks_with_lines(s, d), "extraction_id", "left")


_SQL_BOX = "printf('%.3f,%.3f,%.3f,%.3f', {0}.x, {0}.y, {0}.width, {0}.height)"
_SQL_PRINT = {
    "lines": f"coalesce(x.label, '-') || '|' || coalesce(printf('%.4f', x.confidence), '-') || '|' || {_SQL_BOX.format('x.box')} || '|' || array_to_string(list_transform(x.lines, lambda y: y.text || '@' || {_SQL_BOX.format('y.box')}), chr(10))",
    "text": f"coalesce(x.label, '-') || '|' || coalesce(printf('%.4f', x.confidence), '-') || '|' || {_SQL_BOX.format('x.box')} || '|' || x.text",
}


def _sql_json(body: str) -> str:
    box = lambda b: f"{{'x': {b}.x, 'y': {b}.y, 'width': {b}.w, 'height': {b}.h}}"
    lines = f"list({{'text': text, 'box': {box('box')}}} order by line_no, line_id)" if body == "lines" else "regexp_replace(regexp_replace(string_agg(text, chr(10) order by line_no, line_id), '-\\n', '', 'g'), '\\n', ' ', 'g')"
    none = f"[{{'text': '', 'box': {{'x': 0.0::double, 'y': 0.0::double, 'width': 0.0::double, 'height': 0.0::double}}}}][1:0]" if body == "lines" else "''"
    return f"""with e as (select extraction_id, arg_max(input_file, received_at) as f, arg_max(processed_at, received_at) as p, arg_max(elapsed_seconds, received_at) as s from extractions where extraction_id is not null group by 1),
l as (select block_id, {lines} as ls from {LINES} where text is not null and block_id is not null group by 1),
b as (select b.extraction_id, count(*) as n, list({{'label': label, 'confidence': round_even(case when not isnan(confidence) then confidence end, 4), 'box': {box('b.box')}, '{body}': coalesce(ls, {none})}} order by page_no, block_idx, b.block_id) as bs from {BLOCKS} b left join l on b.block_id = l.block_id group by 1)
select e.extraction_id, coalesce(n, 0)::int as blocks, f as input_file, p as processed_at, round_even(case when not isnan(s) then s end, 2) as seconds, coalesce(md5(array_to_string(list_transform(bs, lambda x: {_SQL_PRINT[body]}), chr(10))), '') as digest from e left join b on e.extraction_id = b.extraction_id"""


def _json_checked(docs: DataFrame, body: str) -> DataFrame:
    """The JSON of every extraction, read back: header, number of blocks, and a digest of all blocks in order."""
    box = "struct<x:double,y:double,width:double,height:double>"
    kind = f"struct<inputFile:string,processedAt:string,elapsedSeconds:double,blockCount:int,blocks:array<struct<label:string,confidence:double,box:{box},{'lines:array<struct<text:string,box:' + box + '>>' if body == 'lines' else 'text:string'}>>>"
    at = lambda b: F.format_string("%.3f,%.3f,%.3f,%.3f", b["x"], b["y"], b["width"], b["height"])
    num = lambda v: F.when(v.isNotNull(), F.format_string("%.4f", v)).otherwise("-")
    text = lambda x: F.array_join(F.transform(x["lines"], lambda y: F.concat(y["text"], F.lit("@"), at(y["box"]))), "\n") if body == "lines" else x["text"]
    one = lambda x: F.concat_ws("|", F.coalesce(x["label"], F.lit("-")), num(x["confidence"]), at(x["box"]), text(x))
    j = docs.withColumn("j", F.from_json("json", kind))
    all_blocks = F.array_join(F.transform("j.blocks", one), "\n")
    return j.select("extraction_id", F.col("j.blockCount").alias("blocks"), F.col("j.inputFile").alias("input_file"), F.col("j.processedAt").alias("processed_at"), F.col("j.elapsedSeconds").alias("seconds"), F.when(F.size("j.blocks") > 0, F.md5(all_blocks)).otherwise("").alias("digest"))


@query(_sql_json("lines"))
def extraction_json(s, d):
    """Detailed JSON of every extraction, with all of its blocks, read back."""
    return _json_checked(sinks.documents(_headed(s, d), ["extraction_id"], ["page_no", "block_idx", "block_id"], F.col("seconds")), "lines")


@query(_sql_json("text"))
def extraction_json_simple(s, d):
    """Simple JSON of every extraction, text instead of lines, read back."""
    return _json_checked(sinks.documents(_headed(s, d), ["extraction_id"], ["page_no", "block_idx", "block_id"], F.col("seconds"), detailed=False), "text")


def _with_lines(s, d):
    return _headed(s, d).where("size(lines) > 0")


@query(f"""with b as (select b.extraction_id, b.page_no, b.block_idx, regexp_replace(regexp_replace(string_agg(l.text, chr(10) order by l.line_no, l.line_id), '-\\n', '', 'g'), '\\n', ' ', 'g') || chr(10) as p from {LINES} l join {BLOCKS} b on l.block_id = b.block_id where l.text is not null group by all)
select extraction_id, string_agg(p, chr(10) order by page_no, block_idx) as text from b where regexp_matches(p, '[^\\s]') and extraction_id in (select extraction_id from extractions) group by extraction_id""")
def extraction_text(s, d):
    """Plain text of every extraction."""
    b = _with_lines(s, d).withColumn("lines", F.transform("lines", lambda x: x["text"]))
    return sinks.plain_text(b, ["extraction_id"], ["page_no", "block_idx"]).where("text <> ''")


@query("""select upper_share, count(*) as n from (select round_even(case when length(label) > 0 then length(regexp_replace(label, '[^A-Z]', '', 'g')) / length(label)::double else 1 end, 2) as upper_share from detections where label is not null) group by 1""")
def sql_functions(s, d):
    """The temporary SQL functions over views."""
    sqlfuncs.register(s)
    sqlfuncs.views(s, d, ["detections"])
    return s.sql("select bround(upper_ratio(label), 2) as upper_share, count(*) as n from detections where label is not null group by 1")


# -- recognition of drawn pages -----------------------------------------------------------------------------------------


LINES_A_TASK = 40_000  # lines whose pages one task draws: some 2000 pages


def drawn_pages(s, d) -> ocr.Pages:
    """Page images drawn from the recognized lines, in the worker that cuts them: every sign but a space is a dark cell of its line's box.

    The number of partitions goes by the lines: by their bytes, lines would meet in few tasks, but each page costs milliseconds of drawing and
    cutting, and with a fixed number the pages that a task sorts and hands to its worker would grow with the table.
    """
    import numpy as np

    lines = table(s, d, "text_lines")
    n = max(int(s.conf.get("spark.sql.shuffle.partitions")), 4 * s.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK))
    l = lines.where("line_id is not null and text is not null and box is not null and extraction_id is not null and page_no is not null")
    l = l.select(*PAGE_KEY, "line_id", "text", "box").repartition(n, *PAGE_KEY).dropDuplicates([*PAGE_KEY, "line_id"])
    g = l.groupBy(*PAGE_KEY).agg(F.collect_list(F.struct("text", "box")).alias("ls"))

    def marks(text: str, left: float) -> list[tuple[int, int]]:
        """Runs of signs other than spaces; left of the page each sign is a run, as it may lie outside."""
        return [m.span() for m in re.finditer(r"\S+" if left >= 0 else r"\S", text)]

    def image(ls):
        img = np.full((int(max(x["box"]["y"] + x["box"]["h"] for x in ls)) + 8, int(max(x["box"]["x"] + x["box"]["w"] for x in ls)) + 8), 255, np.uint8)
        for x in ls:
            t, q, left, step = int(x["box"]["y"]), int(x["box"]["y"] + x["box"]["h"]), x["box"]["x"], x["box"]["w"] / max(len(x["text"]), 1)
            cells = np.full(img.shape[1], 255, np.uint8)
            for k, end in marks(x["text"], left):
                cells[int(left + k * step) : int(left + end * step)] = 0
            np.minimum(img[t:q], cells, out=img[t:q])
        return img

    return ocr.Pages(g, image)


def _page_words(s, d) -> DataFrame:
    """Lines of pages from PDF files stand for the words these bring along."""
    pdf = table(s, d, "page_info").where("pdf_w_pt > 0").select(*PAGE_KEY).distinct()
    return lines_of(s, d).where("text is not null and box is not null").join(pdf, PAGE_KEY).select(*PAGE_KEY, F.col("line_id").alias("word_idx"), "text", "box")


def _shown(b: DataFrame) -> DataFrame:
    return b.select(*PAGE_KEY, "det_idx", "block_idx", "label", r6(F.col("confidence")).alias("confidence"), F.size("lines").alias("lines"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), *flat(F.col("box")))


def _regions(s, d) -> DataFrame:
    return layout.usable(table(s, d, "detections"))


_DRAWN = f"""dl as (select extraction_id, page_no, text, box from {LINES} where text is not null and box is not null), dp as (select extraction_id, page_no, max(box.x + box.w)::double as pw, max(box.y + box.h)::double as ph from dl group by all),
dr as (select d.extraction_id, d.page_no, det_idx, coalesce(nullif(trim(label), ''), 'Text') as label, box, greatest(trunc(box.x)::int, 0) as cx, greatest(trunc(box.y)::int, 0) as cy, least(trunc(box.w)::int, trunc(pw)::int + 8 - greatest(trunc(box.x)::int, 0)) as cw, least(trunc(box.h)::int, trunc(ph)::int + 8 - greatest(trunc(box.y)::int, 0)) as ch
 from detections d join dp on d.extraction_id = dp.extraction_id and d.page_no = dp.page_no where confidence >= 0.25 and box.w > 0 and box.h > 0 and (coalesce(lower(label) = 'table', false) or box.h / box.w < 3.0))"""


@query(f"""with {_DRAWN} select extraction_id, page_no, det_idx, (row_number() over (partition by extraction_id, page_no order by det_idx) - 1)::int as block_idx, label, 1.0::double as confidence, 1::int as lines, cw || 'x' || ch as text, {sql_flat('box.x', 'box.y', 'box.w', 'box.h')} from dr where cw > 0 and ch > 0""")
def region_texts(s, d):
    """A model that reads whole regions, over the crops of drawn pages."""
    return _shown(ocr.region_blocks(drawn_pages(s, d), _regions(s, d), Plugin("stub"), split=False))


@query(f"""with {_DRAWN} select extraction_id, page_no, det_idx, (row_number() over (partition by extraction_id, page_no order by det_idx) - 1)::int as block_idx, label, round_even(1 - (coalesce(rep, 0) / length(t)::double) / 3, 6) as confidence, 1::int as lines, t as text, {sql_flat('box.x', 'box.y', 'box.w', 'box.h')}
 from (select *, cw || 'x' || ch as t, list_sum(list_transform(regexp_extract_all(cw || 'x' || ch, '0{{3,}}|1{{3,}}|2{{3,}}|3{{3,}}|4{{3,}}|5{{3,}}|6{{3,}}|7{{3,}}|8{{3,}}|9{{3,}}'), lambda z: length(z))) as rep from dr where cw > 0 and ch > 0)""")
def heuristic_texts(s, d):
    """A recognizer without scores over the crops: confidence by the penalties of the text."""
    return _shown(ocr.heuristic_blocks(drawn_pages(s, d), _regions(s, d), Plugin("stub")))


@query()
def recognized_windows(s, d):
    """Blocks of the detections: strips, windows of limited width, recognizer, assembly."""
    return _shown(ocr.ocr_blocks(drawn_pages(s, d), _regions(s, d), Plugin("stub"), OcrOptions(segmentation=WordSegmentation.WINDOW)))


@query()
def recognized_words(s, d):
    """The same word by word; lines without a clear split are read whole."""
    return _shown(ocr.ocr_blocks(drawn_pages(s, d), _regions(s, d), Plugin("stub"), OcrOptions(segmentation=WordSegmentation.WORD)))


@query()
def recognized_clusters(s, d):
    """The same with regions parted into groups of ink components."""
    return _shown(ocr.ocr_blocks(drawn_pages(s, d), _regions(s, d), Plugin("stub"), OcrOptions(segmentation=WordSegmentation.PROPORTIONAL, cluster=True)))


@query()
def recognition_pieces(s, d):
    """What the recognizer has to read, with its share of ink, after deskewing and thresholding small images."""
    p = ocr.pieces(ocr.regions(drawn_pages(s, d), _regions(s, d)), OcrOptions(segmentation=WordSegmentation.WINDOW), PreprocessOptions(enabled=True), image=False)
    return p.select(*ocr.REGION, "comp_no", "line_no", "piece_no", "x0", "x1", F.round("ink", 4).alias("ink"), "img_w", "img_h")


@query()
def recognition_counters(s, d):
    """Pieces, widths and errors of every region; its time is left out, as it is never the same."""
    p = ocr.read_pieces(drawn_pages(s, d), _regions(s, d), Plugin("stub"), OcrOptions(segmentation=WordSegmentation.WINDOW))
    return ocr.profile(p).select(*ocr.REGION, "pieces", r6(F.col("mean_width")).alias("mean_width"), "errors")


@query()
def pages_to_json(s, d):
    """From drawn pages and words to the JSON of every extraction: tables, cascade, reading order, merging, sink."""
    blocks, _ = document.extract(drawn_pages(s, d), _page_words(s, d), table(s, d, "detections"))
    e = table(s, d, "extractions").groupBy("extraction_id").agg(F.max_by("input_file", "received_at").alias("input_file"), F.max_by("processed_at", "received_at").alias("processed_at"), F.max_by("elapsed_seconds", "received_at").alias("seconds"))
    return sinks.documents(e.join(blocks, "extraction_id"), ["extraction_id"], ["page_no", "merged_no"], F.col("seconds"))


@query()
def page_logs(s, d):
    """Regions of every page by the stage that settled them."""
    return document.extract(drawn_pages(s, d), _page_words(s, d), table(s, d, "detections"))[1]


def _stage_blocks(s, d, extractor: str) -> DataFrame:
    """Blocks of the extractions that an extractor made; those of none known come from the second."""
    e = table(s, d, "extractions").groupBy("extraction_id").agg(F.max_by("extractor", F.struct("received_at", "extractor")).alias("extractor"))
    made = e.where(F.coalesce("extractor", F.lit("L2")) == extractor).select("extraction_id")
    conf = F.when(F.isnan("confidence") | (F.col("confidence") < 0), None).when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return blocks_of(s, d).withColumn("confidence", F.coalesce(conf, F.lit(0.0))).join(made, "extraction_id", "left_semi")


_CASCADE = f"""with x as (select extraction_id, arg_max(extractor, {{'a': received_at, 'b': extractor}}) as ex from extractions where extractor is not null or extraction_id not in (select extraction_id from extractions where extractor is not null) group by 1),
b as (select b.* exclude (confidence), coalesce(case when isnan(confidence) or confidence < 0 then null when confidence > 1 then confidence / 100 else confidence end, 0) as confidence, coalesce(ex, 'L2') as st from {BLOCKS} b join x on b.extraction_id = x.extraction_id),
o as (select b.extraction_id, b.page_no, b.block_idx, r.det_idx, b.confidence, st, case when b.box.w * b.box.h > 0 then greatest(0, least(r.box.x + r.box.w, b.box.x + b.box.w) - greatest(r.box.x, b.box.x)) * greatest(0, least(r.box.y + r.box.h, b.box.y + b.box.h) - greatest(r.box.y, b.box.y)) / (b.box.w * b.box.h) else 0 end as overlap
 from b join detections r on b.extraction_id = r.extraction_id and b.page_no = r.page_no),
o1 as (select * from o where st = 'L1' and overlap >= 0.5), d1 as (select extraction_id, page_no, det_idx from o1 group by all having avg(confidence) >= 0.75),
o2 as (select o.* from o anti join d1 on o.extraction_id = d1.extraction_id and o.page_no = d1.page_no and o.det_idx = d1.det_idx where st = 'L2' and overlap >= 0.5 qualify row_number() over (partition by o.extraction_id, o.page_no, o.block_idx order by overlap desc, o.det_idx) = 1),
d2 as (select extraction_id, page_no, det_idx from o2 group by all having avg(confidence) >= 0.75), r as (
select o1.extraction_id, o1.page_no, o1.det_idx, o1.block_idx, 'L1' as stage from o1 semi join d1 on o1.extraction_id = d1.extraction_id and o1.page_no = d1.page_no and o1.det_idx = d1.det_idx
union all select o2.extraction_id, o2.page_no, o2.det_idx, o2.block_idx, 'L2' from o2 semi join d2 on o2.extraction_id = d2.extraction_id and o2.page_no = d2.page_no and o2.det_idx = d2.det_idx)
select * from r union all select d.extraction_id, d.page_no, d.det_idx, null, 'pending' from detections d anti join d1 on d.extraction_id = d1.extraction_id and d.page_no = d1.page_no and d.det_idx = d1.det_idx anti join d2 on d.extraction_id = d2.extraction_id and d.page_no = d2.page_no and d.det_idx = d2.det_idx"""


@query(_CASCADE)
def document_extraction(s, d):
    """The cascade over prepared extractor output: each stage offers the blocks that its extractor made; what neither settles is pending."""
    det = table(s, d, "detections").drop("confidence")
    on_pages = lambda b: (lambda pending: b.join(pending.select(*PAGE_KEY).distinct(), PAGE_KEY, "left_semi"))
    stages = [cascade.Stage("L1", on_pages(_stage_blocks(s, d, "L1")), exclusive=False), cascade.Stage("L2", on_pages(_stage_blocks(s, d, "L2")))]
    settled, pending = cascade.run(det, stages)
    left = pending.select(*PAGE_KEY, "det_idx", F.lit(None).cast("int").alias("block_idx"), F.lit("pending").alias("stage"))
    return settled.select(*PAGE_KEY, "det_idx", "block_idx", "stage").unionByName(left)
