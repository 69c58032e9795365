"""Operators against small cases and brute force."""

import json
import os
import random
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import quality as Q
from folioflow.functions import sqlfuncs
from folioflow.functions import stats as S
from folioflow.operators import cluster, decode, layout, models, order, raster, words
from folioflow import schema
from folioflow.plans import cascade, document, materialize, ocr, registry
from folioflow.schema import BOX, DETECTION
from folioflow.sources import files, sinks
from folioflow.streaming import files as streaming

B = f"extraction_id bigint, page_no int, block_idx int, box {BOX}"


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in cols.items()]).select(expr.alias("r")).first().r


@pytest.mark.parametrize("values,peaks", [([10, 10, 10, 30, 10, 10], [3]), ([50, 50, 50, 50, 50, 10], [5]), ([10, 10, 10, 10], []), ([10, 12, 10, 11, 40, 10], [4]), ([1, 99], []), ([], [])])
def test_peaks(spark, values, peaks):
    v = F.array(*[F.lit(float(x)) for x in values]) if values else F.array().cast("array<double>")
    assert spark.range(1).select(S.iqr_peaks(v).alias("r")).first().r == peaks


def test_statistics_of_nothing(spark):
    e = F.array().cast("array<double>")
    r = spark.range(1).select(S.median(e).alias("a"), S.upper_median(e).alias("b"), S.nearest_rank(e, 0.9).alias("c"), S.adaptive_min_area(e).alias("e"), S.otsu(e.cast("array<int>")).alias("f")).first()
    assert list(r) == [0, 0, 0, 4, 0]


def test_otsu_against_histogram(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(0, 30) for _ in range(r.randint(1, 25))]) for i in range(60)]
    got = {x.i: x.t for x in spark.createDataFrame(rows, "i int, v array<int>").select("i", S.otsu(F.col("v")).alias("t")).collect()}
    assert all(got[i] == raster.otsu_values(v) for i, v in rows)


def greedy_bands(boxes):
    """Bands by growing: the next block from the top joins when it overlaps the band by more than nothing."""
    left, bands = sorted(boxes, key=lambda b: (b[1], b[0])), []
    while left:
        band = [left.pop(0)]
        top, bottom = band[0][1], band[0][1] + band[0][2]
        for b in list(left):
            if min(bottom, b[1] + b[2]) - max(top, b[1]) > 0:
                band.append(b)
                left.remove(b)
                bottom = max(bottom, b[1] + b[2])
        bands.append(sorted(x[0] for x in band))
    return bands


def test_reading_order_bands(spark):
    r = random.Random(2)
    pages = {p: [(i, float(r.randint(0, 60)), float(r.choice([0, 0, 1, 3, 8, 15]))) for i in range(8)] for p in range(40)}
    rows = [(p, 1, i, (float(r.randint(0, 50)), y, 5.0, h)) for p, bs in pages.items() for i, y, h in bs]
    got: dict = {}
    for x in order.reading_order(spark.createDataFrame(rows, B)).collect():
        got.setdefault(x.extraction_id, {}).setdefault(x.band, []).append(x.block_idx)
    for p, bs in pages.items():
        assert [sorted(got[p][k]) for k in sorted(got[p])] == greedy_bands(bs)


def test_suppression_against_loop(spark):
    r = random.Random(3)
    rows = [(p, 1, i, "Text", 9, r.randint(0, 20) / 20, (float(r.randint(0, 30)), float(r.randint(0, 30)), 12.0, 12.0)) for p in range(25) for i in range(9)]

    def iou(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        i = max(0, w) * max(0, h)
        return i / (a[2] * a[3] + b[2] * b[3] - i)

    want = set()
    for p in range(25):
        kept = []
        for x in sorted((x for x in rows if x[0] == p), key=lambda x: (-x[5], x[2])):
            if all(iou(k[6], x[6]) <= 0.45 for k in kept):
                kept.append(x)
        want |= {(x[0], x[2]) for x in kept}
    got = {(x.extraction_id, x.det_idx) for x in layout.suppress(spark.createDataFrame(rows, DETECTION)).collect()}
    assert got == want


def test_assign_ties_and_threshold(spark):
    det = spark.createDataFrame([(1, 1, 0, "Text", 9, 0.9, (0.0, 0.0, 10.0, 10.0)), (1, 1, 1, "Text", 9, 0.9, (0.0, 0.0, 10.0, 10.0)), (1, 1, 2, "Text", 9, 0.9, (50.0, 0.0, 10.0, 10.0))], DETECTION).drop("confidence")
    blk = spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 5.0, 5.0)), (1, 1, 1, (55.0, 0.0, 10.0, 10.0)), (1, 1, 2, (58.0, 0.0, 10.0, 10.0)), (1, 1, 3, (0.0, 0.0, 0.0, 5.0))], B)
    assert {(x.block_idx, x.det_idx) for x in layout.assign(det, blk).collect()} == {(0, 0), (1, 2)}
    assert layout.overlaps(det, blk).count() == 3


def test_groups_against_union(spark):
    r = random.Random(4)
    nodes = [(p, 1, i) for p in range(30) for i in range(12)]
    edges = [(p, 1, r.randrange(12), r.randrange(12)) for p in range(30) for _ in range(8)]
    n = spark.createDataFrame(nodes, "extraction_id bigint, page_no int, idx bigint")
    e = spark.createDataFrame(edges, "extraction_id bigint, page_no int, a bigint, b bigint").where("a <> b")
    got = {(x.extraction_id, x.idx): x.cluster for x in cluster.groups(n, e, ["extraction_id", "page_no"], "idx").collect()}
    for p in range(30):
        label = list(range(12))
        for _ in range(12):
            for q, _, a, b in edges:
                if q == p:
                    label[a] = label[b] = min(label[a], label[b])
        assert [got[p, i] for i in range(12)] == label
    assert cluster.groups(n.limit(0), e.limit(0), ["extraction_id", "page_no"], "idx").count() == 0


def test_lines_and_windows(spark):
    w = spark.createDataFrame([(1, 1, 0, "b", 700.0, 50.0, 10.0), (1, 1, 1, "a", 701.0, 5.0, 10.0), (1, 1, 2, "c", 680.0, 5.0, 10.0)], "extraction_id bigint, page_no int, word_idx int, text string, bottom double, left double, height double")
    assert [x.text for x in order.line_texts(order.build_lines(w)).orderBy("line_no").collect()] == ["a b", "c"]
    s = spark.createDataFrame([(1, 0, 100), (1, 120, 550), (1, 560, 640), (1, 700, 900)], "k int, start int, end int")
    assert [(x.start, x.end) for x in order.pack_windows(s, ["k"]).orderBy("window_no").collect()] == [(0, 550), (560, 900)]


def merged_by_hand(blocks):
    """The same fold in plain Python: (label, confidence, box, lines)."""
    out = []
    for label, conf, box, lines in blocks:
        if out:
            pl, pc, pb, ps = out[-1]
            hs = [h for _, (_, _, _, h) in ps + lines if h > 0]
            inter, narrow = min(pb[0] + pb[2], box[0] + box[2]) - max(pb[0], box[0]), min(pb[2], box[2])
            gap = box[1] - (pb[1] + pb[3])
            if pl == label == "Text" and ps and lines and hs and inter > 0 and narrow > 0 and inter / narrow >= 0.5 and -sum(hs) / len(hs) <= gap <= 1.5 * sum(hs) / len(hs):
                last, first = ps[-1][0].rstrip(), lines[0][0].lstrip()
                if last.endswith("-") or last and last[-1] not in ".!?:;" and first[:1].islower():
                    if last.endswith("-"):
                        ps, lines = ps[:-1] + [(last[:-1] + first, ps[-1][1])], lines[1:]
                    x, y = min(pb[0], box[0]), min(pb[1], box[1])
                    out[-1] = (pl, (pc + conf) / 2, (x, y, max(pb[0] + pb[2], box[0] + box[2]) - x, max(pb[1] + pb[3], box[1] + box[3]) - y), ps + lines)
                    continue
        out.append((label, conf, box, lines))
    return out


MERGEABLE = f"extraction_id bigint, page_no int, reading_no int, label string, confidence double, box {BOX}, lines array<struct<text:string,box:{BOX}>>"


def test_merge_paragraphs(spark):
    box = lambda y, h=10.0: (0.0, y, 90.0, h)
    blocks = [("Text", 0.8, (0.0, 0.0, 100.0, 10.0), [("A word is bro- ", box(0.0))]), ("Text", 0.6, box(12.0), [(" ken here", box(12.0))]), ("Text", 1.0, box(24.0), [(" and on it goes.", box(24.0))]), ("Text", 1.0, box(36.0), [("Not this.", box(36.0))]), ("Title", 1.0, box(48.0), []), ("Text", 1.0, box(60.0), [])]
    r = random.Random(6)
    pages = [blocks, [("Text", 1.0, box(0.0, 30.0), [("one", box(0.0)), ("two", box(10.0)), ("three", box(20.0))]), ("Text", 1.0, box(47.0, 14.0), [("four", box(47.0, 14.0))])]]  # three lines of 10 and one of 14: a gap of 17 is too wide
    for _ in range(60):
        y, page = 0.0, []
        for _ in range(6):
            h = float(r.choice([8, 10, 14]))
            lines = [(r.choice(["one ", " two-", "three.", " four five", "Six"]), (0.0, y + k * h, 90.0, r.choice([h, h, 0.0]))) for k in range(r.randint(0, 3))]
            page.append((r.choice(["Text", "Text", "Text", "Title"]), r.random(), (float(r.choice([0, 0, 60])), y, 90.0, h * max(1, len(lines))), lines))
            y += h * max(1, len(lines)) + r.choice([-9, 0, 5, 12, 17])
        pages.append(page)
    rows = [(n, 1, k, *b) for n, page in enumerate(pages) for k, b in enumerate(page)]
    got: dict = {}
    for x in order.merge_paragraphs(spark.createDataFrame(rows, MERGEABLE)).orderBy("extraction_id", "merged_no").collect():
        got.setdefault(x.extraction_id, []).append((x.label, round(x.confidence, 9), tuple(x.box), [(l.text, tuple(l.box)) for l in x.lines]))
    for n, page in enumerate(pages):
        assert got[n] == [(a, round(c, 9), b, ls) for a, c, b, ls in merged_by_hand(page)], n
    assert [len(b[3]) for b in got[0]] == [2, 1, 0, 0] and [t for t, _ in got[0][0][3]] == ["A word is broken here", " and on it goes."] and len(got[1]) == 2


def test_median_filter_and_batches(spark):
    rows = [(1, i, (0.0, 0.0, 10.0 * i, h)) for i, h in enumerate([10.0, 10.0, 3.0, 11.0])] + [(2, 9, (0.0, 0.0, 1.0, 1.0)), (2, 10, (0.0, 0.0, 1.0, 50.0))]
    df = spark.createDataFrame(rows, f"g int, i int, box {BOX}")
    assert {x.i for x in order.median_height_filter(df, ["g"]).collect()} == {0, 1, 3, 9, 10}
    assert order.width_batches(df, ["g"], F.col("box.w"), "i", 2).where("g = 1").select("batch").distinct().count() == 2


def test_word_boundaries(spark):
    spans = [(1, 0, 10), (1, 12, 20), (1, 22, 30), (1, 60, 70), (1, 72, 80)]
    g = words.segment_gaps(spark.createDataFrame(spans, "k int, left int, right int"), ["k"])
    for method in ("cca", "rlsa"):
        assert [x.word for x in words.boundaries(g, ["k"], method).orderBy("span_no").collect()] == [0, 0, 0, 1, 1]


@given(st.text(min_size=0, max_size=40), st.lists(st.integers(0, 50), max_size=12))
@settings(max_examples=300, deadline=None)
def test_share_out_against_rounds(text, widths):
    got, n, total = decode.share_out(text, [float(w) for w in widths]), len(text), sum(widths)
    if n == 0 or len(widths) < 2 or total == 0:
        assert got == text
        return
    quota = [float(w) / float(total) * n for w in widths]
    counts = [max(1, int(q)) for q in quota]
    rest = [q - c for q, c in zip(quota, counts)]
    extra = n - sum(counts)
    for _ in range(abs(extra)):
        may = [i for i in range(len(counts)) if extra > 0 or counts[i] > 1]
        if not may:
            break
        i = min(may, key=lambda i: (-rest[i] if extra > 0 else rest[i], i))
        counts[i] += 1 if extra > 0 else -1
        rest[i] += -1 if extra > 0 else 1
    parts, at = [], 0
    for c in counts:
        if at < n:
            parts.append(text[at : at + c])
            at += c
    assert got == " ".join(parts) and at >= n


def test_ctc(spark):
    seq = [0, 1, 1, 0, 1, 2, 0, 0, 0, 3]
    rows = [(7, t, [1.0 if c == k else 0.0 for k in range(4)]) for t, c in enumerate(seq)]
    df = spark.createDataFrame(rows, "k int, t int, p array<double>")
    r = decode.ctc(df, ["k"], "t", "p", ["a", "b", "c"]).first()
    assert (r.text, r.score) == ("aabc", 1.0)
    assert decode.ctc_spaced(df, ["k"], "t", "p", ["a", "b", "c"], 3).first().text == "aab c"
    assert decode.ctc(df.limit(1), ["k"], "t", "p", ["a"]).first().score == 0.0


def test_tokens(tmp_path):
    p = tmp_path / "v.json"
    p.write_text(json.dumps({"<s>": 0, "h": 1, "Ġé".replace("é", "Ã©"): 2}))
    v = decode.load_vocabulary(str(p))
    assert decode.tokens_to_text([0, 1, 2], v) == "h é"
    assert decode.load_vocabulary(str(tmp_path / "none")) == {}
    assert decode.greedy_tokens(lambda t: [0, 0, 1] if len(t) > 2 else [0, 1, 0], 0, 2, 20) == [1, 1]


def page(*bars):
    img = np.full((60, 200, 3), 255, np.uint8)
    for t, b, l, r in bars:
        img[t:b, l:r] = 0
    return img


def test_raster_lines_and_words():
    img = page((10, 20, 10, 60), (10, 20, 70, 120), (40, 50, 10, 60))
    assert raster.line_strips(img, 0) == [(10, 20), (40, 50)]
    line = page(*[(20, 40, x, x + 8) for x in (0, 14, 28, 90, 104, 118)])
    for f in (raster.words_by_components, raster.words_by_smearing, raster.words_by_oversplit):
        assert len(f(line)) == 2
    assert len(raster.components(raster.mean_grey(img) < 128)) == 3
    soft = raster.resize(line, 2 * line.shape[0], 2 * line.shape[1])
    assert [(round(a / 2), round(b / 2)) for a, b in raster.windows(soft, 120)] == [(0, 36), (90, 126)]
    assert raster.windows(line, 60) == []  # a line of two greys has nothing under its threshold and is read whole
    assert raster.words_by_smearing(page((20, 40, 0, 50))) == []


def test_raster_measures():
    g = np.full((64, 200), 255, np.uint8)
    g[10:14], g[30:34] = 0, 0
    assert raster.skew(g) == 0.0 and 0 <= raster.otsu_grey(g) < 255 and raster.row_variance(g) > 0
    assert abs(raster.skew(raster.rotate(g, 3.0)) + 3.0) <= 0.5
    assert raster.resize(g, 48, 150).shape == (48, 150) and raster.upscaled(g[:20]).shape[0] == 64
    t, s, px, py = raster.letterbox(page(), 640)
    assert t.shape == (3, 640, 640) and abs(s - 3.2) < 1e-9 and py == (640 - 192) / 2 and px == 0
    assert raster.recognizer_batch([page(), page()[:, :50]]).shape == (2, 3, 48, 160)
    assert raster.preprocess(page()).shape == (60, 200) and raster.stretched(page(), 32).shape == (3, 32, 32)
    ink = np.ones((100, 400), bool)
    ink[:, 195:206] = False
    assert raster.column_gaps(ink) == [(195, 205)]
    assert raster.usable_components([(0, 0, 10, 10, 90), (0, 0, 1, 100, 100), (0, 0, 2, 2, 1)], 500, 500) == [(0, 0, 10, 10, 90)]


def png(path, w, h):
    raw = b"".join(b"\x00" + b"\xff\x00\x00" * w for _ in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    png(tmp_path / "in" / "a.png", 4, 3)
    png(tmp_path / "in" / "sub" / "B.PNG", 5, 2)
    (tmp_path / "in" / "note.txt").write_text("x")
    assert files.listed(spark, [str(tmp_path / "in")]).count() == 2
    assert files.listed(spark, [str(tmp_path / "in" / "note.txt")]).count() == 1
    (tmp_path / "void").mkdir()
    with pytest.warns(UserWarning, match="skipped"):
        assert files.listed(spark, [str(tmp_path / "none.pdf"), str(tmp_path / "void"), str(tmp_path / "in")]).count() == 2
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        files.listed(spark, [str(tmp_path / "none.pdf")])
    p = files.image_pages(spark, str(tmp_path / "in")).where("document_id = 'a'").first()
    assert (p.img_w, p.img_h, p.page_id, p.pdf_w_pt) == (4, 3, "page_1", 0.0)
    assert files.pixels(p.data, 3, 4, p.channels)[0, 0].tolist() == [255, 0, 0]
    paths = spark.createDataFrame([("x/A.pdf", 0), ("x/a.PDF", 1), ("y.docx", 2)], "path string, o int")
    assert [x.path for x in files.first_of_each(paths, "path", "o").orderBy("o").collect()] == ["x/A.pdf", "y.docx"]
    with pytest.raises(Exception, match="not supported"):
        files.with_format(paths, strict=True).collect()
    assert files.settings(str(tmp_path / "no.json")) == {}
    (tmp_path / "s.json").write_text('{"Ocr": {"MaxBatch": 3}}')
    assert files.settings(str(tmp_path / "no.json"), str(tmp_path / "s.json")) == {"ocr": {"maxbatch": 3}}
    root = {"eos_token_id": 5, "encoder": {"image_size": 32, "patch_size": 16, "hidden_size": 48}, "decoder": {"d_model": 64, "decoder_attention_heads": 4, "decoder_layers": 6, "vocab_size": 99, "max_length": 20, "decoder_start_token_id": 9}}
    assert files.encoder_settings(root, {"eos_token_id": 7, "max_length": 64}) == {"layers": 6, "heads": 4, "head_dim": 16, "vocabulary": 99, "hidden": 48, "sequence": 5, "longest": 64, "start": 9, "end": 7}
    assert (files.encoder_settings(root)["end"], files.encoder_settings(root)["longest"]) == (5, 20)
    (tmp_path / "in" / "odd.bmp").write_bytes(b"grey")

    def odd(content):
        if content != b"grey":
            raise ValueError
        return np.full((2, 3), 7, np.uint8)

    got = {x.document_id: x for x in files.all_image_pages(spark, str(tmp_path / "in"), [lambda c: 1 / 0, odd]).collect()}
    assert set(got) == {"a", "B", "odd"} and (got["odd"].img_w, got["odd"].img_h, got["odd"].channels) == (3, 2, 1) and files.pixels(got["odd"].data, 2, 3, 1).max() == 7


def test_pdf_plugin(spark):
    def render(content):
        if content == b"bad":
            raise ValueError
        return [(595, 842, [("w", 1.0, 2.0, 3.0, 4.0)]), (595, 842, [])]

    rows = spark.createDataFrame([("d/x.pdf", bytearray(b"ok")), ("d/y.pdf", bytearray(b"bad"))], "path string, content binary")
    got = files.pdf_pages(spark, rows, render).collect()
    assert [(x.document_id, x.page_id) for x in got] == [("x", "page_1"), ("x", "page_2")] and got[0].words[0].text == "w" and got[0].data is None

    def painted(content):
        for n in range(3):
            if n == 2:
                raise ValueError
            yield 620.0 * (n + 1), 10.0, [], lambda scale: np.dstack([np.zeros((4, int(2 * scale), 3), np.uint8), np.full((4, int(2 * scale), 1), 0, np.uint8)])

    got = files.pdf_pages(spark, rows.limit(1), painted).orderBy("page_no").collect()
    assert [(x.page_no, x.img_w, x.img_h, x.channels) for x in got] == [(1, 8, 4, 3), (2, 4, 4, 3)] and set(bytes(got[0].data)) == {255}  # clear pixels stand on white


def test_sinks(spark, tmp_path):
    rows = [(1, 0, "f.pdf", "2024-01-01T00:00:00Z", "Text", 0.12345, (1.0, 2.0, 3.0, 4.0), [("bro-", (0.0, 0.0, 1.0, 1.0)), ("ken ж", (0.0, 0.0, 1.0, 1.0))]), (1, 1, "f.pdf", None, None, 0.5, (1.0, 2.0, 3.0, 4.0), [])]
    df = spark.createDataFrame(rows, f"doc bigint, n int, input_file string, processed_at string, label string, confidence double, box {BOX}, lines array<struct<text:string,box:{BOX}>>")
    full = json.loads(sinks.documents(df, ["doc"], ["n"], F.lit(2.5)).first().json)
    assert full["blockCount"] == 2 and full["blocks"][0]["confidence"] == 0.1234 and "label" not in full["blocks"][1] and full["blocks"][0]["lines"][1]["text"] == "ken ж"
    simple = sinks.documents(df, ["doc"], ["n"], detailed=False)
    assert json.loads(simple.first().json)["blocks"][0]["text"] == "broken ж"
    text = sinks.plain_text(df.withColumn("lines", F.transform("lines", lambda x: x["text"])), ["doc"], ["n"])
    assert text.first().text == "broken ж\n"
    named = simple.select("doc", "json", sinks.output_name(F.lit("in/scan.v2.pdf"), "simple").alias("name"))
    sinks.write_documents(named, str(tmp_path / "d"), "json", "name")
    assert [tuple(x) for x in spark.read.parquet(str(tmp_path / "d")).collect()] == [("in/scan.v2_extracted_simple.json", named.first().json)]
    sinks.write_files(named, str(tmp_path / "f"), "json", "name")
    sinks.write_files(named, str(tmp_path / "f"), "json", "name")  # a task that runs again writes the same
    assert json.loads((tmp_path / "f/in/scan.v2_extracted_simple.json").read_text())["blockCount"] == 2 and len(list((tmp_path / "f/in").iterdir())) == 1
    bare = spark.createDataFrame([(7, None, "g.png", None, None, None, None, [])], df.schema)
    assert json.loads(sinks.documents(bare, ["doc"], ["n"], F.lit(float("nan"))).first().json) == {"inputFile": "g.png", "blockCount": 0, "blocks": []}


def test_cascade_and_models(spark):
    det = spark.createDataFrame([(1, 1, i, "Text", 9, 0.9, (20.0 * i, 0.0, 10.0, 10.0)) for i in range(3)], DETECTION).drop("confidence")

    def blocks(conf):
        return lambda pending: pending.select("extraction_id", "page_no", F.col("det_idx").alias("block_idx"), "box", F.lit("t").alias("text")).withColumn("confidence", conf)

    stages = [cascade.Stage("L1", blocks(F.when(F.col("block_idx") == 0, 0.9).otherwise(0.2)), exclusive=False), cascade.Stage("L2", blocks(F.when(F.col("block_idx") == 1, 0.9).otherwise(0.2)), costly=True)]
    settled, pending = cascade.run(det, stages)
    assert {(x.det_idx, x.stage) for x in settled.collect()} == {(0, "L1"), (1, "L2")} and [x.det_idx for x in pending.collect()] == [2]
    last, none = cascade.run(det, [cascade.Stage("L4", blocks(F.lit(0.0)), gated=False)])
    assert last.count() == 3 and none.count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, x string")
    got = {x.i: (x.text, x.score, x.error) for x in models.recognize(rows, "x", models.Plugin("stub")).collect()}
    assert got == {1: ("a", 1.0, None), 2: ("", 0.0, None)}
    bad = models.recognize(rows, "x", models.Plugin("none")).collect()
    assert all("KeyError" in x.error for x in bad)


def test_symbols(tmp_path):
    (tmp_path / "d").write_text("a\n\nb\n")
    assert models.symbols(str(tmp_path / "d"), True) == ["a", "", "b", " "] and models.symbols(str(tmp_path / "d"), keep_blank=False) == ["a", "b"]


def test_quality_edges(spark):
    t = F.col("t")
    df = spark.createDataFrame([("",), ("AAAb",), ("a\u0001�",), (None,)], "t string")
    got = [tuple(x) for x in df.select(Q.upper_ratio(t), Q.repeated_ratio(t), Q.unprintable_ratio(t)).collect()]
    assert got[0] == (1.0, 1.0, 1.0) and got[1] == (0.75, 0.75, 0.0) and abs(got[2][2] - 2 / 3) < 1e-9
    assert one(spark, Q.block_confidence()) == 1.0 and one(spark, Q.line_confidence(F.lit(1.7))) == 1.0


def test_decode_anchors(spark):
    row = (1, 1, 0, 320.0, 320.0, 100.0, 50.0, [0.1, 0.9], 0.5, 0.0, 80.0, 1280, 960)
    df = spark.createDataFrame([row, (*row[:7], [0.1, 0.2], *row[8:])], "extraction_id bigint, page_no int, anchor int, cx double, cy double, w double, h double, scores array<double>, scale double, pad_x double, pad_y double, img_w int, img_h int")
    got = layout.decode_anchors(df).collect()
    assert len(got) == 1 and got[0].label == "Footnote" and tuple(got[0].box) == (540.0, 430.0, 200.0, 100.0)
    c = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.5, 0.5, 99, 0.8), (1, 1, 1, 0.0, 0.0, 0.5, 0.5, 1, 0.4)], "extraction_id bigint, page_no int, anchor int, x0 double, y0 double, x1 double, y1 double, class_idx int, confidence double")
    r = layout.decode_corners(c).collect()
    assert len(r) == 1 and r[0].label == "Unknown" and r[0].box.w == 320.0


def test_geometry_edges(spark):
    a, b = (F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xywh", t)]) for t in ((0, 0, 10, 10), (10, 10, 0, 5)))
    r = spark.range(1).select(G.iou(a, b).alias("i"), G.overlap_fraction(a, b).alias("o"), G.gap_distance(a, b).alias("g"), G.overlap_x_fraction(a, b).alias("x"), G.overlaps_x(a, b).alias("m")).first()
    assert (r.i, r.o, r.g, r.x, r.m) == (0.0, 0.0, 0.0, 0.0, True)


def test_sql_functions(spark):
    assert "box_iou" in sqlfuncs.register(spark)
    assert spark.sql("select box_iou(named_struct('x',0D,'y',0D,'w',2D,'h',2D), named_struct('x',1D,'y',0D,'w',2D,'h',2D)) as v, file_stem('a/b.c.pdf') as s").first() == (1 / 3, "b.c")


def test_stream(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 5.0, 5.0)), (1, 1, 1, (0.0, 9.0, 5.0, 5.0))], B).write.parquet(str(src))
    q = streaming.run(streaming.stream_of(spark, str(src), B), order.reading_order, str(out), "order")
    q.awaitTermination(60)
    assert spark.read.parquet(str(out)).count() == 2


def test_empty_tables(spark):
    det, blk = spark.createDataFrame([], DETECTION), spark.createDataFrame([], B)
    assert layout.suppress(det).count() == layout.usable(det).count() == order.reading_order(blk).count() == layout.assign(det.drop("confidence"), blk).count() == 0


def test_neighbours_against_all_pairs(spark):
    r = random.Random(11)
    pages = {p: [(i, (float(r.randint(0, 300)), float(r.randint(0, 300)), float(r.randint(0, 30)), float(r.randint(0, 20)))) for i in range(n)] for p, n in ((1, 1), (2, 3), (3, 700), (None, 4))}
    df = spark.createDataFrame([(p, 1, i, b) for p, bs in pages.items() for i, b in bs], B)
    got: dict = {}
    for x in cluster.neighbours(df, ["extraction_id", "page_no"], "block_idx", 5).collect():
        got.setdefault((x.extraction_id, x.a), []).append((x.rank, x.b, round(x.distance, 9)))

    def gap(a, b):
        dx, dy = max(0.0, a[0] - (b[0] + b[2]), b[0] - (a[0] + a[2])), max(0.0, a[1] - (b[1] + b[3]), b[1] - (a[1] + a[3]))
        return round((dx * dx + dy * dy) ** 0.5, 9)

    want = {(p, i): [(k, j, d) for k, (d, j) in enumerate(sorted((gap(b, c), j) for j, c in bs if j != i)[:5], 1)] for p, bs in pages.items() if p for i, b in bs if len(bs) > 1}
    assert {k: sorted(v) for k, v in got.items()} == want
    nodes = cluster.groups(df, df.limit(0).select("extraction_id", "page_no", F.col("block_idx").alias("a"), F.col("block_idx").alias("b")), ["extraction_id", "page_no"], "block_idx")
    assert nodes.count() == df.count() and nodes.where("block_idx <> cluster").isEmpty()


def test_no_edge_crosses_a_column_gap(spark):
    left, right = [(i, (0.0, 20.0 * i, 40.0, 10.0)) for i in range(12)], [(20 + i, (60.0, 20.0 * i, 40.0, 10.0)) for i in range(12)]
    df = spark.createDataFrame([(1, 1, i, b) for i, b in left + right], B)
    gaps = spark.createDataFrame([(1, 1, [(42.0, 58.0)])], "extraction_id bigint, page_no int, gaps array<struct<l:double,r:double>>")
    cross = lambda e: {(x.a < 20) != (x.b < 20) for x in e.collect()}
    keys = ["extraction_id", "page_no"]
    assert True in cross(cluster.component_edges(df, keys, "block_idx")) and cross(cluster.component_edges(df, keys, "block_idx", gaps=gaps)) == {False}


# -- recognition of pages -----------------------------------------------------------------------------------------------

PAGES = "extraction_id bigint, page_no int, img_w int, img_h int, channels int, data binary"


def text_page(rows, w=400, h=200):
    """A page with lines of words: (y, height, [(x, width)])."""
    img = np.full((h, w), 255, np.uint8)
    for y, hh, ws in rows:
        for x, ww in ws:
            img[y : y + hh, x : x + ww] = 0
    return img


def test_recognition_puts_lines_in_their_place(spark):
    img = text_page([(20, 12, [(10, 40), (60, 50), (130, 40)]), (50, 12, [(10, 80), (110, 60)]), (120, 14, [(220, 90)])])
    pages = spark.createDataFrame([(1, 1, 400, 200, 1, bytearray(img.tobytes())), (2, 1, 400, 200, 1, None)], PAGES)
    det = spark.createDataFrame([(1, 1, 0, "Text", 9, 0.9, (5.0, 10.0, 200.0, 70.0)), (1, 1, 1, " ", 9, 0.9, (210.0, 100.0, 500.0, 60.0)), (1, 1, 2, "Title", 9, 0.9, (-10.0, 0.0, 5.0, 5.0)), (1, 1, 3, "Text", 9, 0.9, (500.0, 0.0, 50.0, 50.0)), (1, 1, 4, "Text", 9, 0.9, None), (2, 1, 0, "Text", 9, 0.9, (0.0, 0.0, 50.0, 50.0))], DETECTION)
    W = schema.WordSegmentation
    got = {m: {(x.det_idx, x.label): x for x in ocr.ocr_blocks(pages, det, models.Plugin("stub"), schema.OcrOptions(segmentation=m)).collect()} for m in W}
    for m in W:
        assert set(got[m]) == {(0, "Text"), (1, "Text")}, m  # blank, empty and missing regions give nothing
        a, b = got[m][0, "Text"], got[m][1, "Text"]
        assert [tuple(l.box) for l in a.lines] == [(5.0, 16.0, 200.0, 16.0), (5.0, 46.0, 200.0, 16.0)] and tuple(a.box) == (5.0, 16.0, 200.0, 46.0)
        assert [tuple(l.box) for l in b.lines] == [(210.0, 116.0, 190.0, 18.0)]
    assert [l.text for l in got[W.NONE][0, "Text"].lines] == ["200x16", "200x16"]
    assert [l.text for l in got[W.WORD][0, "Text"].lines] == ["101x16 41x16", "200x16"] and got[W.WORD][1, "Text"].lines[0].text == "190x18"  # without a clear split the line is read whole
    window = got[W.WINDOW][0, "Text"].lines[0].text
    assert window.endswith("x48") and int(window.split("x")[0]) < 600  # 48 high, margins cut off
    assert abs(got[W.NONE][0, "Text"].confidence - 1.0) < 0.2


def test_equal_rows_are_stretched_once():
    line = text_page([(4, 12, [(10, 40), (60, 50)])], 130, 16)
    rows, row = raster.resized_rows(line, 48, 390)
    assert len(rows) < 24 and len(row) == 48 and np.array_equal(rows[row], raster.resize(line, 48, 390))
    assert np.array_equal(raster.dark(rows, np.bincount(row))[row], raster.dark(rows[row]))
    ink = np.array([[1, 1, 0, 1], [1, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 0]], bool)
    assert raster.components(ink) == [(0, 0, 4, 3, 7)]


def test_pages_are_made_where_they_are_cut(spark):
    rows = [(1, 1, 20), (1, 2, 60), (2, 1, 90)]
    draw = lambda y: text_page([(y, 12, [(10, 40), (60, 50), (130, 40)])])
    det = spark.createDataFrame([(e, p, 0, "Text", 9, 0.9, (5.0, 10.0, 200.0, 150.0)) for e, p, _ in rows], DETECTION)
    small = ocr.Pages(spark.createDataFrame(rows, "extraction_id bigint, page_no int, y int"), draw)
    table = spark.createDataFrame([(e, p, 400, 200, 1, bytearray(draw(y).tobytes())) for e, p, y in rows], PAGES)
    assert "data" not in ocr.regions(small, det).src.columns  # no pixels are shuffled
    for o in (schema.OcrOptions(segmentation=schema.WordSegmentation.WINDOW), schema.OcrOptions(cluster=True)):
        got = [sorted(map(repr, ocr.ocr_blocks(x, det, models.Plugin("stub"), o).collect())) for x in (small, table)]
        assert got[0] == got[1] and len(got[0]) >= 3
    b = ocr.heuristic_blocks(small, det, models.Plugin("stub")).collect()
    assert sorted(x.lines[0].text for x in b) == ["200x150"] * 3


def test_component_confidence_is_that_of_its_lines(spark):
    line = (0.0, 0.0, 10.0, 10.0)
    rows = [(1, 1, 0, "Text", 0, line, k, (0.0, y, 90.0, 10.0), t, s) for k, (y, t, s) in enumerate([(0.0, "ab cd", 0.9), (12.0, "ABCD", 0.8), (24.0, "  ", 0.1), (90.0, "ab", 0.4), (102.0, "ab", 0.4)])]
    df = spark.createDataFrame(rows, f"extraction_id bigint, page_no int, det_idx int, label string, comp_no int, comp_box {BOX}, line_no int, line_box {BOX}, text string, score double")
    got = ocr.assembled(df).collect()
    want = (0.9 + 0.8 * (1 - 1 / 3) + 0.4 + 0.4) / 4  # blank lines count neither as lines nor in the mean
    assert len(got) >= 1 and all(abs(x.confidence - want) < 1e-9 for x in got) and sum(len(x.lines) for x in got) == 4


def test_components_are_read_on_their_own(spark):
    rows = [(20 * k + 10, 10, [(10 + 14 * i, 10) for i in range(8)]) for k in range(6)]
    img = text_page(rows + [(y, h, [(x + 260, w) for x, w in ws]) for y, h, ws in rows])
    pages = spark.createDataFrame([(1, 1, 400, 200, 1, bytearray(img.tobytes()))], PAGES)
    det = spark.createDataFrame([(1, 1, 0, "Text", 9, 0.9, (0.0, 0.0, 400.0, 200.0)), (1, 1, 1, "Title", 9, 0.9, (0.0, 0.0, 400.0, 200.0)), (1, 1, 2, "Text", 9, 0.9, (130.0, 0.0, 100.0, 60.0))], DETECTION)
    got = {x.det_idx: x.comps for x in ocr.components(ocr.crops(pages, det), schema.OcrOptions(cluster=True)).collect()}
    assert len(got[0]) > 1 and all(c.x + c.w <= 130 or c.x >= 260 for c in got[0])  # no group spans the columns
    assert [(c.y, c.x) for c in got[0]] == sorted((c.y, c.x) for c in got[0])
    assert [tuple(c) for c in got[1]] == [(0.0, 0.0, 400.0, 200.0)] and [tuple(c) for c in got[2]] == [(0.0, 0.0, 100.0, 60.0)]  # whole: one piece, or no ink


def test_a_page_with_clusters_is_made_once(spark, tmp_path):
    log = str(tmp_path / "made")

    def draw(y):
        with open(log, "a") as f:
            f.write("page\n")
        return text_page([(y, 12, [(10, 40), (60, 50), (130, 40)])])

    pages = ocr.Pages(spark.createDataFrame([(1, p, 20 * p) for p in (1, 2, 3)], "extraction_id bigint, page_no int, y int"), draw)
    det = spark.createDataFrame([(1, p, 0, "Text", 9, 0.9, (5.0, 10.0, 200.0, 150.0)) for p in (1, 2, 3)], DETECTION)
    got = ocr.ocr_blocks(pages, det, models.Plugin("stub"), schema.OcrOptions(segmentation=schema.WordSegmentation.PROPORTIONAL, cluster=True))
    assert len(got.collect()) >= 3 and len(open(log).readlines()) == 3


def test_groups_in_the_worker_are_those_of_the_edges(spark):
    r = np.random.default_rng(5)
    boxes = {(1, p): np.unique(r.integers((0, 0, 2, 2), (300, 200, 40, 14), (n, 4)), axis=0).astype(float) for p, n in enumerate((1, 2, 9, 30, 90))}
    df = spark.createDataFrame([(e, p, i, tuple(b.tolist())) for (e, p), bs in boxes.items() for i, b in enumerate(bs)], B)
    spark.createDataFrame([(1, 4, [(140.0, 150.0), (200.0, 201.0)])], "extraction_id bigint, page_no int, gaps array<struct<l:double,r:double>>").createOrReplaceTempView("column_gaps")
    keys = ["extraction_id", "page_no"]
    edges = cluster.component_edges(df, keys, "block_idx", gaps=spark.table("column_gaps"))
    want = {(x.page_no, x.block_idx): x.cluster for x in cluster.groups(df, edges, keys, "block_idx").collect()}
    got = {(p, i): g for (_, p), bs in boxes.items() for i, g in enumerate(cluster.component_groups(bs, [(140, 150), (200, 201)] if p == 4 else ()).tolist())}
    assert got == want and len({g for (p, _), g in got.items() if p == 4}) > 1


def test_components_of_several_masks_are_those_of_each():
    r = np.random.default_rng(3)
    inks = [np.repeat(r.random((r.integers(1, 9), r.integers(1, 30))) < 0.4, r.integers(1, 4), 0) for _ in range(40)]
    many = raster.components_of([raster.banded(i) for i in inks])
    assert many == [raster.components(i) for i in inks] and all(sum(x[4] for x in found) == i.sum() for found, i in zip(many, inks))
    lines = [np.where(i, 0, 255).astype(np.uint8) for i in inks]
    assert raster.words_of([raster.banded(x) for x in lines]) == [raster.words_by_components(x) for x in lines]
    assert raster.otsu_values([1, 1, 9, 10]) == 1 and raster.otsu_values([4, 4]) == 0


def test_tasks_of_drawn_pages_do_not_grow(spark, tmp_path, monkeypatch):
    rows = [(i, 1, i // 2, 9, "ab cd", (5.0, 10.0 + 20 * (i % 2), 90.0, 12.0)) for i in range(60)]
    spark.createDataFrame(rows, f"line_id bigint, page_no int, extraction_id bigint, line_no int, text string, box {BOX}").write.parquet(str(tmp_path / "text_lines.parquet"))
    few = registry.drawn_pages(spark, str(tmp_path)).rows.rdd.getNumPartitions()
    monkeypatch.setattr(registry, "LINES_A_TASK", 1, raising=False)
    many = registry.drawn_pages(spark, str(tmp_path)).rows
    assert few == 16 and many.rdd.getNumPartitions() == 60 and many.count() == 30
    r = ocr.regions(registry.drawn_pages(spark, str(tmp_path)), spark.createDataFrame([(e, 1, 0, "Text", 9, 0.9, (0.0, 0.0, 95.0, 60.0)) for e in range(30)], DETECTION))
    cut = r.cut
    page = next(ocr.cut_pieces(r, schema.OcrOptions(segmentation=schema.WordSegmentation.WORD), schema.PreprocessOptions(), "cca").cut(iter(r.src.limit(1).toArrow().to_batches())))
    whole = next(cut(iter(r.src.limit(1).toArrow().to_batches())))
    assert page and not any(np.shares_memory(x[-1], w[-1]) for x in page for w in whole) and all(x[-1].base is None for x in page)  # a piece that waits holds no page


def plainly_turned(g, degrees):
    """Linear interpolation over white, a pixel at a time."""
    h, w = g.shape
    a, out = np.deg2rad(degrees), np.empty(g.shape)
    at = lambda y, x: int(g[y, x]) if 0 <= y < h and 0 <= x < w else 255
    for y in range(h):
        for x in range(w):
            u, v = np.cos(a) * (x - w / 2) - np.sin(a) * (y - h / 2) + w / 2, np.sin(a) * (x - w / 2) + np.cos(a) * (y - h / 2) + h / 2
            i, j = int(np.floor(v)), int(np.floor(u))
            p, q = v - i, u - j
            out[y, x] = (at(i, j) * (1 - q) + at(i, j + 1) * q) * (1 - p) + (at(i + 1, j) * (1 - q) + at(i + 1, j + 1) * q) * p
    return out


def test_skewed_crops_are_turned_and_thresholded():
    r = np.random.default_rng(2)
    g = r.integers(0, 256, (37, 50)).astype(np.uint8)
    assert all(np.abs(raster.rotate(g, a) - plainly_turned(g, a)).max() <= 0.51 for a in (-5.0, 0.5, 40.0))
    assert np.array_equal(raster.rotate(g, 0.0), g)
    text = np.full((140, 300), 255, np.uint8)
    for y in range(20, 120, 20):
        text[y : y + 8, 20:280] = 0
    for img in (g, text, raster.rotate(text, 2.0), raster.rotate(text, -3.5), r.integers(0, 256, (90, 33)).astype(np.uint8)):
        spread = [raster.row_variance(raster.rotate(img, a)) for a in np.arange(-5, 5.5, 0.5)]
        assert raster.skew(img) == -5 + 0.5 * int(np.argmax(spread))  # the first of the best
    assert raster.row_variance(np.array([[0, 127], [128, 255]])) == 1.0  # dark pixels are counted, not their ink
    tilted = raster.rotate(text, 3.0)
    assert raster.skew(tilted) == -3.0 and raster.skew(np.full((70, 90), 255, np.uint8)) == -5.0
    assert len(raster.line_strips(tilted)) == 1 and len(raster.line_strips(raster.preprocess(tilted))) == 5
    low = tilted[:59]
    assert np.array_equal(raster.preprocess(low), np.where(raster.adaptive_ink(low), 0, 255))  # too low to be turned
    k = np.exp(-((np.arange(31) - 15) ** 2) / 50)
    along = lambda x, axis: np.apply_along_axis(lambda v: np.convolve(v, k / k.sum(), "valid"), axis, x)
    for img in (g, tilted, g[:1], g[:, :1]):
        assert np.array_equal(raster.adaptive_ink(img), img <= np.rint(along(along(np.pad(img.astype(float), 15, mode="edge"), 1), 0)) - 10)


def test_recognition_pieces_are_those_of_preprocessed_crops(spark, tmp_path):
    rows = [(1, 1, 1, 1, "ab cd", (5.0, 10.0, 250.0, 12.0)), (2, 1, 1, 2, "abcd", (5.0, 60.0, 250.0, 90.0))]
    spark.createDataFrame(rows, f"line_id bigint, page_no int, extraction_id bigint, line_no int, text string, box {BOX}").write.parquet(str(tmp_path / "text_lines.parquet"))
    boxes = [(0.0, 0.0, 255.0, 30.0), (0.0, 50.0, 255.0, 108.0)]
    spark.createDataFrame([(1, 1, k, "Text", 9, 0.9, b) for k, b in enumerate(boxes)], DETECTION).write.parquet(str(tmp_path / "detections.parquet"))
    page = np.full((158, 263), 255, np.uint8)
    page[10:22, 5:105] = page[10:22, 155:255] = page[60:150, 5:255] = 0
    want = []
    for k, (_, y, w, h) in enumerate(boxes):
        work = raster.preprocess(page[int(y) : int(y + h), : int(w)])
        for n, (top, bottom) in enumerate(raster.line_strips(work)):
            line = raster.resize(work[top:bottom], 48, round(work.shape[1] * 48 / (bottom - top)))  # not upscaled before
            for i, (x0, x1) in enumerate(raster.windows(line)):
                x0, x1 = max(0, x0 - 4), min(line.shape[1], x1 + 5)
                want.append((k, n, i, x0, x1, round(float(raster.dark(line)[:, x0:x1].mean()), 4), x1 - x0, 48))
    got = sorted(tuple(x[c] for c in ("det_idx", "line_no", "piece_no", "x0", "x1", "ink", "img_w", "img_h")) for x in registry.recognition_pieces(spark, str(tmp_path)).collect())
    assert got == want and {x[0] for x in got} == {0, 1}
    assert all(x[5] < 0.5 for x in got if x[0] == 1)  # the middle of a block of ink is no darker than what is around it


def test_read_by_width_and_errors(spark):
    seen = []

    def make():
        def run(xs):
            if any(x.shape[1] == 13 for x in xs):
                raise ValueError("thirteen")
            return [(f"{x.shape[1]}", 0.5) for x in xs]

        return run

    df = spark.createDataFrame([(1, 1, i, w, 2, 1, bytearray(2 * w)) for i, w in enumerate([30, 13, 7, 50])], "extraction_id bigint, page_no int, det_idx int, img_w int, img_h int, channels int, data binary").coalesce(1)
    got = {x.img_w: x for x in ocr.read(df, models.Plugin("by-width", factory=make), 2).collect()}
    assert (got[30].text, got[50].text, got[50].score) == ("30", "50", 0.5) and got[13].text == got[7].text == "" and "thirteen" in got[13].error and got[30].error is None and not seen
    p = {x.det_idx: x for x in ocr.profile(ocr.read(df, models.Plugin("by-width", factory=make), 1)).collect()}
    assert p[1].errors == 1 and p[0].errors == 0 and p[0].pieces == 1 and abs(sum(x.share for x in p.values()) - 100) < 1e-6


def test_document_from_page_to_json(spark):
    img = text_page([(20, 12, [(10, 60), (80, 70)]), (100, 12, [(10, 90)]), (150, 12, [(10, 50)])])
    pages = spark.createDataFrame([(e, 1, 400, 200, 1, bytearray(img.tobytes())) for e in (1, 2)], PAGES)
    det = spark.createDataFrame([(e, 1, k, lab, 9, 0.9, box) for e in (1, 2) for k, (lab, box) in enumerate([("Text", (0.0, 10.0, 200.0, 40.0)), ("TABLE", (0.0, 90.0, 200.0, 40.0)), ("Text", (0.0, 140.0, 200.0, 30.0)), ("Text", (300.0, 0.0, 20.0, 190.0)), ("Text", (250.0, 150.0, 60.0, 40.0))])], DETECTION)
    words = spark.createDataFrame([(1, 1, 1, "embedded", (10.0, 20.0, 60.0, 12.0)), (1, 1, 2, "words", (80.0, 20.0, 70.0, 12.0))], f"extraction_id bigint, page_no int, word_idx bigint, text string, box {BOX}")
    blocks, log = document.extract(pages, words, det)
    got = {(x.extraction_id, tuple(x.box)[:2]): [l.text for l in x.lines] for x in blocks.collect()}
    assert got[1, (10.0, 20.0)] == ["embedded words"] and got[2, (0.0, 16.0)][0].endswith("x48")  # words where there are any, else the recognizer
    assert got[1, (0.0, 90.0)] == got[2, (0.0, 90.0)] == ["200x40"]  # the table as one piece
    assert got[1, (250.0, 150.0)] == ["60x40"]  # an empty region goes to the last model
    assert not any(b == (300.0, 0.0) for _, b in got)  # tall and narrow
    assert {x.extraction_id: (x.by_l1, x.by_l2, x.by_l3, x.by_table, x.left_over) for x in log.collect()} == {1: (1, 1, 1, 1, 0), 2: (0, 2, 1, 1, 0)}
    none = document.Options(models=document.Models(regions=None))
    left = document.extract(pages, words, det, none)[1]
    assert {x.extraction_id: x.left_over for x in left.collect()} == {1: 1, 2: 1}
    b, seen = document.observed(document.blocks_of_pages(pages, words, det)[0])
    assert b.count() == seen.get["blocks"] == 8 and seen.get["tables"] == 2
    assert [x.lines[0].text for x in document.extract(pages.limit(0), words, det)[0].collect()] == ["embedded words"] and document.extract(pages, words.limit(0), det.limit(0))[0].count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {n for f in [blocks.getAllFiles()] for i in range(f.size()) if (n := f.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}
    before = held()
    t = materialize.written(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counts")
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.1)
    assert not left and {x.k: x.n for x in t.collect()} == {k: len(range(k, 5000, 7)) for k in range(7)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_many_characters_are_no_strong_text(spark):
    words = spark.createDataFrame([(1, 1, 1, "short", (0.0, 0.0, 10.0, 10.0)), (2, 1, 1, "a" * 90, (0.0, 0.0, 10.0, 10.0))], f"extraction_id bigint, page_no int, word_idx bigint, text string, box {BOX}")
    strong = lambda **o: {x.extraction_id: x.strong for x in cascade.strong_text(words, ["word_idx"], schema.CascadeOptions(**o)).collect()}
    assert strong() == {1: True, 2: True} and strong(max_chars=50) == {1: True, 2: False}
