"""Recognition of page images: detections to crops, components, lines, pieces, texts and blocks.

Pages are one row each and meet their detections by an equi-join on the page. A worker cuts one page at a time and reads its
pieces (lines, words or windows) on the spot, so pixels are neither shuffled nor handed on; pages that can be made from
something smaller than their image (``Pages``) are made there too. What the recognizer says is put together again relationally:
pieces to lines, lines to components with the mean of the lines' confidences, components to paragraphs. Recognizers are
plug-ins of ``operators.models``; a stage that fails on a piece gives an ``error`` and no text.

Nulls: pages without data, detections without a box and crops without area give nothing. Images are of any size a page
has; as one row holds a page, ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds the pages a worker holds at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import quality as Q
from ..operators import cluster, decode, layout, order, raster
from ..operators.models import Plugin
from ..schema import ATOMIC, BOX, LINE, PAGE_KEY, OcrOptions, PreprocessOptions, WordSegmentation
from ..sources.files import pixels
from .materialize import written

REGION = [*PAGE_KEY, "det_idx"]
_IMAGE = "img_w int, img_h int, channels int, data binary"


def _packed(img: np.ndarray) -> tuple[int, int, int, bytes]:
    """(width, height, channels, data) as image sources have it: channels last, colours turned round."""
    if img.ndim == 2:
        return img.shape[1], img.shape[0], 1, np.ascontiguousarray(img).tobytes()
    return img.shape[1], img.shape[0], 3, np.ascontiguousarray(img[..., 2::-1]).tobytes()


@dataclass(frozen=True)
class Pages:
    """Pages whose images are made in the worker that cuts them: only ``rows`` are shuffled, never pixels.

    ``rows``: page key and further columns; ``image`` makes an image of these, in their order.
    """

    rows: DataFrame
    image: Callable[..., np.ndarray]


def _images(pages: DataFrame | Pages) -> Pages:
    if isinstance(pages, Pages):
        return pages
    return Pages(pages.where("data is not null").select(*PAGE_KEY, "img_w", "img_h", "channels", "data"), lambda w, h, ch, data: pixels(data, h, w, ch))


@dataclass(frozen=True)
class Regions:
    """The crops of detections before they are cut: ``src`` has a page and its detections in each row, ``cut`` makes the crops."""

    src: DataFrame
    cut: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]]  # a page at a time: (page key, det_idx, label, box, crop)


def regions(pages: DataFrame | Pages, detections: DataFrame) -> Regions:
    """Crops to be cut inside the worker that uses them."""
    p = _images(pages)
    held = [F.col("det_idx"), F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Text")).alias("label"), F.col("box")]
    dets = detections.where("box is not null").groupBy(*PAGE_KEY).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("dets"))
    image = p.image

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for b in batches:
            for i in range(b.num_rows):
                e, p, *of, dets = (c[i].as_py() for c in b.columns)
                img = image(*of)
                h, w = img.shape[:2]
                out = []
                for d in dets:
                    x, y = max(int(d["box"]["x"]), 0), max(int(d["box"]["y"]), 0)
                    cw, chh = min(int(d["box"]["w"]), w - x), min(int(d["box"]["h"]), h - y)
                    if cw > 0 and chh > 0:
                        out.append((e, p, d["det_idx"], d["label"], d["box"], img[y : y + chh, x : x + cw]))
                yield out

    return Regions(p.rows.join(dets, PAGE_KEY), cut)


def _uncut(cropped: DataFrame) -> Regions:
    """Crops that are a table already."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for b in batches:
            for i in range(b.num_rows):
                e, p, d, label, box, w, h, ch, data = (c[i].as_py() for c in b.columns)
                yield [(e, p, d, label, box, pixels(data, h, w, ch))]

    return Regions(cropped.select(*REGION, "label", "box", "img_w", "img_h", "channels", "data"), cut)


def crops(pages: DataFrame | Pages, detections: DataFrame) -> DataFrame:
    """(page key, det_idx, label, box, crop image): the pixels of every detection; ``label`` is Text where there is none.

    ``pages``: page key, img_w, img_h, channels, data; ``detections``: page key, det_idx, label, box in pixels.
    """
    r = regions(pages, detections)
    cut = r.cut
    return r.src.mapInArrow(lambda batches: (_rows([(*x[:5], *_packed(x[5])) for x in found], _CROP) for found in cut(batches)), _CROP)


_CROP = f"extraction_id bigint, page_no int, det_idx int, label string, box {BOX}, {_IMAGE}"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), BOX: pa.struct([(k, pa.float64()) for k in "xywh"]), f"array<{BOX}>": pa.list_(pa.struct([(k, pa.float64()) for k in "xywh"])), "array<double>": pa.list_(pa.float64()), "array<struct<l:double,r:double>>": pa.list_(pa.struct([("l", pa.float64()), ("r", pa.float64())]))}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


# -- components -------------------------------------------------------------------------------------------------------

_COMPS = f"extraction_id bigint, page_no int, det_idx int, comps array<{BOX}>"


def _box(x: float, y: float, w: float, h: float) -> dict[str, float]:
    return {"x": float(x), "y": float(y), "w": float(w), "h": float(h)}


def ink_groups(crops: list[tuple[str, tuple[np.ndarray, np.ndarray]]]) -> list[list[dict[str, float]]]:
    """The groups of the crops' ink components of text size, from top to bottom, then left to right; none of a label that is read as one piece.

    Crops come with their label and are given by their bands: the rows that differ, and how often each stands.
    """
    parted = [k for k, (label, _) in enumerate(crops) if label.lower() not in ATOMIC]
    inks = [(raster.binarize(raster.weighted_grey(rows), times), times) for rows, times in (crops[k][1] for k in parted)]
    out: list[list[dict[str, float]]] = [[] for _ in crops]
    for k, found, (ink, times) in zip(parted, raster.components_of(inks), inks):
        parts = raster.text_sized(found, int(times.sum()), ink.shape[1])
        if parts:
            l, t, r, b, _ = np.array(parts).T
            groups: dict[int, list[int]] = {}
            for g, *x in zip(cluster.component_groups(np.stack([l, t, r - l, b - t], 1), raster.column_gaps(ink, times)).tolist(), *(v.tolist() for v in (t, l, r, b))):
                u = groups.setdefault(g, x)
                groups[g] = [min(u[0], x[0]), min(u[1], x[1]), max(u[2], x[2]), max(u[3], x[3])]
            out[k] = [_box(x, y, right - x, bottom - y) for y, x, _, right, bottom in sorted((y, x, g, right, bottom) for g, (y, x, right, bottom) in groups.items())]
    return out


def components(cropped: DataFrame, o: OcrOptions) -> DataFrame:
    """(region key, comps): boxes inside each crop that are read on their own, from top to bottom, then left to right.

    The whole crop, or, with clustering, the groups of its ink components; labels that are read as one piece stay whole, and
    so do crops without ink of text size.
    """
    r = _uncut(cropped)
    cut = r.cut

    def of(found: list[tuple]) -> list[list[dict[str, float]]]:
        groups = ink_groups([(x[3], raster.banded(x[5])) for x in found]) if o.cluster else [[] for _ in found]
        return [g or [_box(0, 0, x[5].shape[1], x[5].shape[0])] for g, x in zip(groups, found)]

    return r.src.mapInArrow(lambda batches: (_rows([(*x[:3], c) for x, c in zip(found, of(found))], _COMPS) for found in cut(batches)), _COMPS)


# -- pieces -----------------------------------------------------------------------------------------------------------

PIECE = f"extraction_id bigint, page_no int, det_idx int, label string, comp_no int, comp_box {BOX}, line_no int, line_box {BOX}, piece_no int, x0 int, x1 int, ink double, spans array<double>, {_IMAGE}"
#: Words of lines, given by their bands.
SPLITTERS: dict[str, Callable[[list[tuple[np.ndarray, np.ndarray]]], list[list[tuple[int, int]]]]] = {
    "cca": raster.words_of, "rlsa": lambda lines: [raster.words_by_smearing(*x) for x in lines], "aom": lambda lines: [raster.words_by_oversplit(*x) for x in lines]
}


def median_strips(strips: list[tuple[int, int]], ratio: float) -> list[tuple[int, int]]:
    """Strips not much lower than the median of three or more; never none of them."""
    if len(strips) < 3:
        return strips
    m = float(np.median([b - t for t, b in strips]))
    return [s for s in strips if s[1] - s[0] >= m * ratio] or strips


def _lines(found: list[tuple], o: OcrOptions, prep: PreprocessOptions) -> Iterator[tuple]:
    """The lines of a page's crops: the first columns of ``PIECE``, the rows that differ, and which of them each row is.

    Equal rows are looked at once, and the components of all crops are linked in one go.
    """
    edges = [raster.bands(x[5]) for x in found]
    groups = ink_groups([(x[3], raster.banded(x[5], e)) for x, e in zip(found, edges)]) if o.cluster else [[] for _ in found]
    works, dark = [], []
    for (e, p, d, label, box, crop), edge, comps in zip(found, edges, groups):
        for comp_no, c in enumerate(comps or [_box(0, 0, crop.shape[1], crop.shape[0])]):
            cx, cy = max(int(c["x"]), 0), max(int(c["y"]), 0)
            comp = crop[cy : cy + int(c["h"]), cx : cx + int(c["w"])]
            if not comp.size:
                continue
            place = {"x": box["x"] + c["x"], "y": box["y"] + c["y"], "w": c["w"], "h": c["h"]}
            made = raster.preprocess(comp, prep) if prep.enabled else None
            work = comp if made is None else made
            rows = [0, *(y - cy for y in edge if 0 < y - cy < len(comp)), len(comp)] if made is None else raster.bands(work)
            works.append(((e, p, d, label, comp_no, place), work, rows))
            seen, times = raster.banded(work, rows)
            dark.append((raster.mean_grey(seen) < 128, times))
    for (at, work, rows), parts in zip(works, raster.components_of(dark)):
        place = at[5]
        for line_no, (top, bottom) in enumerate(median_strips(raster.strips_of(parts, o.top_pad), o.median_ratio)):
            line_box = {"x": place["x"], "y": place["y"] + top, "w": float(work.shape[1]), "h": float(bottom - top)}
            if o.segmentation is WordSegmentation.WINDOW or prep.enabled:
                line = work[top:bottom]
                if o.segmentation is WordSegmentation.WINDOW:  # stretched to one height at once, so that low lines are not upscaled before
                    line, row = raster.resized_rows(line, o.line_height, max(1, round(line.shape[1] * o.line_height / line.shape[0])))
                    yield (*at, line_no, line_box), line, np.bincount(row), row
                    continue
                line, times = raster.banded(raster.upscaled(line, prep.upscale_under, prep.upscale_to))
            else:
                line, times = raster.banded(work, rows, top, bottom)
            yield (*at, line_no, line_box), line, times, np.arange(len(times)).repeat(times)


def _pieces(found: list[tuple], o: OcrOptions, prep: PreprocessOptions, splitter: str) -> Iterator[tuple]:
    """The rows of ``PIECE`` of a page's crops, each with its image instead of the columns of one."""
    lines = list(_lines(found, o, prep))
    kind = o.segmentation
    split = SPLITTERS[splitter]([x[1:3] for x in lines]) if kind in (WordSegmentation.WORD, WordSegmentation.PROPORTIONAL) else [[] for _ in lines]
    pad = o.pad if kind is WordSegmentation.WINDOW else 0
    for (at, line, times, row), cuts in zip(lines, split):
        dark = raster.dark(line, times)
        if kind is WordSegmentation.WINDOW:
            cuts = raster.windows(dark if o.min_ink <= 0 else dark[row], o.window, o.min_gap, o.min_ink)
        spans = [float(r - l + 1) for l, r in cuts] if kind is WordSegmentation.PROPORTIONAL else []
        for piece_no, (x0, x1) in enumerate(cuts if cuts and not spans else [(0, line.shape[1] - 1)]):
            x0, x1 = max(0, x0 - pad), min(line.shape[1], x1 + 1 + pad)
            ink = dark[:, x0:x1]
            share = int(np.count_nonzero(ink, axis=1) @ times) / (len(row) * ink.shape[1])
            yield *at, piece_no, x0, x1, share, spans, line[:, x0:x1][row]


def cut_pieces(r: Regions, o: OcrOptions, prep: PreprocessOptions, splitter: str) -> Cut:
    """Pieces that stay in the worker until they are read."""
    cut = r.cut
    return Cut(r.src, lambda batches: (list(_pieces(found, o, prep, splitter)) for found in cut(batches)), PIECE.removesuffix(f", {_IMAGE}"))


def pieces(cropped: DataFrame | Regions, o: OcrOptions = OcrOptions(), prep: PreprocessOptions = PreprocessOptions(), splitter: str = "cca", image: bool = True) -> DataFrame:
    """What a recognizer has to read: lines, or their words or windows, with their place. Boxes are those of the page.

    Lines come from strips of ink, with ``o.median_ratio`` applied; a line of which no part is left is read whole.
    ``image`` off leaves out the pixels.
    """
    if not isinstance(cropped, Regions):
        cropped = _uncut(cropped)
    c = cut_pieces(cropped, o, prep, splitter)
    cut = c.cut
    if image:
        return c.src.mapInArrow(lambda batches: (_rows([(*x[:-1], *_packed(x[-1])) for x in found], PIECE) for found in cut(batches)), PIECE)
    kept = PIECE.removesuffix(", channels int, data binary")
    return c.src.mapInArrow(lambda batches: (_rows([(*x[:-1], x[-1].shape[1], x[-1].shape[0]) for x in found], kept) for found in cut(batches)), kept)


# -- reading ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """Images before they are cut: ``cut`` makes rows of ``columns`` and, last, the image."""

    src: DataFrame
    cut: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]]
    columns: str


def _read(images: list[np.ndarray | Callable[[], np.ndarray]], widths: list[int], plugin: Plugin, batch: int) -> list[tuple]:
    """(text, score, error, ms) of every image. Images are read by width, ``batch`` at a time."""
    n = len(images)
    out: list[tuple] = [("", 0.0, None, 0.0)] * n
    by_width = sorted(range(n), key=lambda i: (widths[i], i))
    for at in range(0, n, batch):
        part = by_width[at : at + batch]
        start, got, error = time.perf_counter(), [("", 0.0)] * len(part), None
        try:
            got = [(t or "", float(s)) for t, s in plugin.session()([images[i]() if callable(images[i]) else images[i] for i in part])]
        except Exception as ex:  # noqa: BLE001
            error = f"{type(ex).__name__}: {ex}"
        ms = (time.perf_counter() - start) * 1000 / len(part)
        for i, (t, s) in zip(part, got):
            out[i] = (t, s, error, ms)
    return out


def read(images: DataFrame | Cut, plugin: Plugin, batch: int = 32) -> DataFrame:
    """Replace the image by text, score, error and milliseconds, its width stays. Images are read by width, ``batch`` at a time."""
    result = "text string, score double, error string, ms double"
    if isinstance(images, Cut):
        schema, cut = f"{images.columns}, img_w int, {result}", images.cut

        def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(held: list[tuple]) -> pa.RecordBatch:
                widths = [x[-1].shape[1] for x in held]
                return _rows([(*x[:-1], w, *r) for x, w, r in zip(held, widths, _read([x[-1] for x in held], widths, plugin, batch))], schema)

            held: list[tuple] = []
            for found in cut(batches):
                held += found
                if len(held) >= 8 * batch:  # images of several pages, so that batches are full and alike in width
                    yield done(held)
                    held = []
            yield done(held)

        return images.src.mapInArrow(fused, schema)
    rest = [c for c in images.columns if c not in ("img_h", "channels", "data")]
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, h, ch, data = (b.column(c).to_pylist() for c in ("img_w", "img_h", "channels", "data"))
            got = _read([partial(pixels, *x) for x in zip(data, h, w, ch)], w, plugin, batch)
            cols = [b.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64())))], names=[*rest, "text", "score", "error", "ms"])

    return images.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", {result}")


def lines_read(found: DataFrame, o: OcrOptions) -> DataFrame:
    """Lines (region key, label, comp_no, comp_box, line_no, line_box, text, score) from read pieces, joined in order."""
    keys = [*REGION, "comp_no", "line_no"]
    # a line is known by its place, which all of its pieces share, so one group gives its place and its text
    out = decode.join_parts(found, keys, "piece_no", trim=o.segmentation is WordSegmentation.WINDOW, keep=["label", "comp_box", "line_box", "spans"])
    if o.segmentation is WordSegmentation.PROPORTIONAL:
        out = out.withColumn("text", F.when(F.size("spans") > 1, decode.shared_out(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return out.drop("spans")


def assembled(lines: DataFrame, penalties: list[Callable[[Column], Column]] = (Q.upper_ratio, Q.repeated_ratio, Q.unprintable_ratio)) -> DataFrame:
    """Blocks (page key, det_idx, block_idx, label, confidence, box, lines) from lines: paragraphs of every component.

    A line's confidence is its score less the mean penalty; every paragraph of a component has the mean of its lines'.
    Blank lines leave. A paragraph's box surrounds its lines.
    """
    comp = [*REGION, "comp_no"]
    l = lines.where(Q.not_blank(F.col("text"))).withColumn("conf", Q.line_confidence(F.col("score"), *[p(F.col("text")) for p in penalties]))
    l = l.withColumn("comp", F.struct(*comp)).withColumn("box", F.col("line_box"))
    l = order.split_paragraphs(l.select("comp", "label", "line_no", "box", "text", "conf"), "comp")
    l = l.withColumn("confidence", F.avg("conf").over(Window.partitionBy("comp")))  # in the exchange of the paragraphs: lines are made once
    g = l.groupBy("comp", "paragraph").agg(F.any_value("label").alias("label"), F.any_value("confidence").alias("confidence"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.struct("text", "box").alias("l")))), lambda x: x["l"]).alias("lines"), G.union_agg(F.col("box")).alias("box"))
    g = g.select("comp.*", "paragraph", "label", "confidence", "box", "lines")
    return numbered(g, ["det_idx", "comp_no", "paragraph"])


def numbered(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks numbered on their page in the order of ``by``."""
    no = F.row_number().over(Window.partitionBy(*PAGE_KEY).orderBy(*by)) - 1
    return blocks.withColumn("block_idx", no.cast("int")).select(*REGION, "block_idx", "label", "confidence", "box", "lines")


def read_pieces(pages: DataFrame | Pages, detections: DataFrame, plugin: Plugin, o: OcrOptions = OcrOptions(), prep: PreprocessOptions = PreprocessOptions(), splitter: str = "cca") -> DataFrame:
    """The pieces of detections with what a recognizer says of them. A page is cut, parted and read in one worker."""
    return read(cut_pieces(regions(pages, detections), o, prep, splitter), plugin, o.batch)


def ocr_blocks(pages: DataFrame | Pages, detections: DataFrame, plugin: Plugin, o: OcrOptions = OcrOptions(), prep: PreprocessOptions = PreprocessOptions(), splitter: str = "cca") -> DataFrame:
    """Blocks recognized in the detections of page images."""
    return assembled(lines_read(read_pieces(pages, detections, plugin, o, prep, splitter), o))


def profile(found: DataFrame) -> DataFrame:
    """Counters of a recognition run by region: pieces, mean width, milliseconds, errors and each region's share of the time."""
    g = found.groupBy(*REGION).agg(F.count(F.lit(1)).alias("pieces"), F.avg("img_w").alias("mean_width"), F.sum("ms").alias("ms"), F.count("error").alias("errors"))
    total = F.sum("ms").over(Window.partitionBy())
    return g.withColumn("share", F.coalesce(F.lit(100.0) * F.col("ms") / F.nullif(total, F.lit(0.0)), F.lit(0.0)))


def region_blocks(pages: DataFrame | Pages, detections: DataFrame, plugin: Plugin, split: bool = True, scored: bool = True) -> DataFrame:
    """Blocks of a model that reads whole regions: tables, or text of several lines. Every line has the region's box.

    With ``split`` the text is cut into its non-empty trimmed lines. The confidence is the model's (``scored``) or none.
    """
    r = regions(pages, detections)
    cut = r.cut
    whole = Cut(r.src, cut, _CROP.removesuffix(f", {_IMAGE}"))
    found = read(whole, plugin, 1).where(Q.not_blank(F.col("text")))
    texts = Q.text_lines(F.col("text")) if split else F.array("text")
    lines = F.transform(texts, lambda t: F.struct(t.alias("text"), F.col("box").alias("box")))
    out = found.select(*REGION, "label", (F.col("score") if scored else F.lit(0.0)).alias("confidence"), "box", lines.alias("lines")).where("size(lines) > 0")
    return numbered(out, ["det_idx"])


def heuristic_blocks(pages: DataFrame | Pages, detections: DataFrame, plugin: Plugin) -> DataFrame:
    """Blocks of a recognizer without scores: a line's confidence is 1 less the mean of its text's penalties, a block's their mean."""
    b = region_blocks(pages, detections, plugin, scored=False)
    conf = lambda x: G.clamp(1 - (Q.upper_ratio(x["text"]) + Q.repeated_ratio(x["text"]) + Q.unprintable_ratio(x["text"])) / 3, 0.0, 1.0)
    return b.withColumn("confidence", F.aggregate(F.transform("lines", conf), F.lit(0.0), lambda a, v: a + v) / F.size("lines"))


def embedded_blocks(words: DataFrame, detections: DataFrame, strong: DataFrame) -> DataFrame:
    """Blocks of the words a file brings along. ``words``: page key, word_idx, text, box with y downwards; ``strong``: page key, strong.

    On pages whose words look like text: words inside a region, grouped, built to lines, lines to paragraphs, confidence by
    the block metrics. On other pages every region has an empty block of confidence 0, so that it goes on to the next stage.
    """
    gate = strong.select(*PAGE_KEY, "strong")
    dets = detections.join(gate, PAGE_KEY)
    weak = dets.where("not strong").select(*REGION, "label", F.lit(0.0).alias("confidence"), "box", F.array().cast(f"array<{LINE}>").alias("lines"), F.lit(0).alias("line_no"))
    labels = dets.where("strong").select(*REGION, "label", "box")
    inside = written(layout.words_in_regions(words.select(*PAGE_KEY, "word_idx", "text", "box"), labels), "words-in-regions")
    groups = cluster.groups(inside, cluster.word_edges(inside, REGION, "word_idx"), REGION, "word_idx")
    # a write after each step, as the shuffle files of a step go with it
    w = written(inside.join(groups, [*REGION, "word_idx"]), "word-groups").withColumn("comp", F.struct(*REGION, "cluster"))
    built = order.build_lines(w.select("comp", "word_idx", (-(F.col("box.y") + F.col("box.h"))).alias("bottom"), F.col("box.x").alias("left"), F.col("box.h").alias("height"), "text"), keys=["comp"])
    placed = built.join(w.select("comp", "word_idx", "box"), ["comp", "word_idx"])
    lines = placed.groupBy("comp", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word_idx", "text"))), lambda x: x["text"]), " ").alias("text"), G.union_agg(F.col("box")).alias("box"))
    lines = written(lines, "word-lines")
    paras = order.split_paragraphs(lines, "comp").groupBy("comp", "paragraph").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.struct("text", "box").alias("l")))), lambda x: x["l"]).alias("lines"), G.union_agg(F.col("box")).alias("box"))
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "")
    conf = Q.block_confidence(Q.line_count_metric(F.size("lines"), F.length(text)), Q.upper_ratio(text))
    b = paras.select("comp.*", "paragraph", conf.alias("confidence"), "box", "lines").join(labels.select(*REGION, "label"), REGION)
    strong_blocks = b.select(*REGION, "label", "confidence", "box", "lines", (F.col("cluster") * 1000 + F.col("paragraph")).alias("line_no"))
    return numbered(strong_blocks.unionByName(weak), ["det_idx", "line_no"])
