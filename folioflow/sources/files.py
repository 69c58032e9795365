"""Sources: folders of documents, images, prepared tables, settings and dictionaries."""

from __future__ import annotations

import json
import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp
from ..schema import IMAGE_TYPES

ACCEPTED = ("pdf", *IMAGE_TYPES)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def accepted(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files of an accepted type."""
    return paths.where(extension(F.col(path)).isin(*ACCEPTED))


def first_of_each(paths: DataFrame, path: str, order: str) -> DataFrame:
    """One row per path whatever its case: the first in order."""
    by = Window.partitionBy(F.lower(path)).orderBy(order)
    return paths.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def with_format(paths: DataFrame, path: str = "path", strict: bool = False) -> DataFrame:
    """Add format: pdf, image or unsupported; strict raises on the last."""
    e = extension(F.col(path))
    other = F.raise_error(F.concat(F.lit("not supported: "), F.col(path))) if strict else F.lit("unsupported")
    return paths.withColumn("format", F.when(e == "pdf", "pdf").when(e.isin(*IMAGE_TYPES), "image").otherwise(other))


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modified) of folders (recursively, accepted types) and single files (as they are).

    A missing path or a folder without accepted files is warned of and left out; with nothing left, an error is raised.
    """
    dirs = [p for p in paths if Path(p).is_dir()]
    files = [p for p in paths if not Path(p).is_dir()]
    for p in [p for p in files if "://" not in p and not Path(p).exists()]:
        warnings.warn(f"path not found, skipped: {p}", stacklevel=2)
        files.remove(p)
    for p in [p for p in dirs if not any(f.suffix[1:].lower() in ACCEPTED for f in Path(p).rglob("*") if f.is_file())]:
        warnings.warn(f"no supported documents in folder, skipped: {p}", stacklevel=2)
        dirs.remove(p)
    out = None
    for group, recursive in ((dirs, True), (files, False)):
        if group:
            d = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(group).select("path", "length", F.col("modificationTime").alias("modified"))
            d = accepted(d) if recursive else d
            out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no valid input files")
    return out


def pdf_scale(width_pt: Column) -> Column:
    """Raster scale of a PDF page: 2480 pixels wide, between 1 and 300 dpi; 300 dpi without a width."""
    return F.when(width_pt > 0, clamp(2480 / F.nullif(width_pt, F.lit(0.0)), 1.0, 300 / 72)).otherwise(F.lit(300 / 72))


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page per image file; undecodable files leave."""
    d = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)
    i = F.col("image")
    return d.select(i["origin"].alias("path"), stem(i["origin"]).alias("document_id"), F.lit("page_1").alias("page_id"), F.lit(1).alias("page_no"), F.lit(0.0).alias("pdf_w_pt"), F.lit(0.0).alias("pdf_h_pt"), i["width"].alias("img_w"), i["height"].alias("img_h"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def pixels(data: bytes, height: int, width: int, channels: int):
    """Array of an image row, RGB."""
    import numpy as np

    a = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a[..., [2, 1, 0]] if channels == 3 else a[..., [2, 1, 0, 3]]


PAGE_IMAGE = "path string, document_id string, page_id string, page_no int, pdf_w_pt double, pdf_h_pt double, img_w int, img_h int, channels int, data binary"


def decoded(spark: SparkSession, contents: DataFrame, decoders: list) -> DataFrame:
    """One page per image file (path, content): the first decoder that succeeds counts; a decoder is ``bytes -> array`` (grey, RGB or RGBA).

    Rows are decoded one at a time; files that no decoder reads leave, transparent ones stand on white.
    """
    import pandas as pd

    from ..operators.raster import over_white

    def read(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                for decode in decoders:
                    try:
                        img = decode(bytes(content))
                    except Exception:  # noqa: BLE001, S112
                        continue
                    if img is not None and img.size:
                        img = over_white(img) if img.ndim == 3 and img.shape[2] == 4 else img
                        data = img.tobytes() if img.ndim == 2 else img[..., ::-1].tobytes()
                        yield pd.DataFrame([(path, Path(path).stem, "page_1", 1, 0.0, 0.0, img.shape[1], img.shape[0], 1 if img.ndim == 2 else 3, data)], columns=[f.split()[0] for f in PAGE_IMAGE.split(", ")])
                        break

    return contents.where("path is not null and content is not null").select("path", "content").mapInPandas(read, PAGE_IMAGE)


def all_image_pages(spark: SparkSession, path: str, decoders: list) -> DataFrame:
    """Pages of a folder's images: the built-in decoder's, and those of the fallbacks for the files it cannot read."""
    ok = image_pages(spark, path)
    files = accepted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")).where(extension(F.col("path")) != "pdf")
    rest = files.join(ok.select("path"), "path", "left_anti")
    return ok.select(*[f.split()[0] for f in PAGE_IMAGE.split(", ")]).unionByName(decoded(spark, rest, decoders))


def pdf_pages(spark: SparkSession, paths: DataFrame, render) -> DataFrame:
    """Pages of PDF files by a plug-in ``render(bytes)`` that yields (width_pt, height_pt, words[, paint]) page by page.

    ``paint(scale)`` gives the page's raster as an RGBA array, which stands on white at the scale of ``pdf_scale``. A page leaves
    the worker before the next is drawn; a file that fails gives the pages before the failure. Without ``paint`` there is no image.

    (path, document_id, page_id, page_no, pdf_w_pt, pdf_h_pt, img_w, img_h, channels, data, words).
    """
    import pandas as pd

    from ..operators.raster import over_white

    schema = PAGE_IMAGE + ", words array<struct<text:string,left:double,bottom:double,right:double,top:double>>"
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                name = Path(path).stem
                try:
                    for n, (w, h, words, *paint) in enumerate(render(bytes(content)), 1):
                        image = (None, None, None, None)
                        if paint and paint[0] is not None:
                            img = over_white(paint[0](min(max(2480 / w, 1.0), 300 / 72) if w > 0 else 300 / 72))
                            image = (img.shape[1], img.shape[0], 3, img[..., ::-1].tobytes())
                        yield pd.DataFrame([(path, name, f"page_{n}", n, float(w), float(h), *image, words)], columns=names).astype({"img_w": "Int32", "img_h": "Int32", "channels": "Int32"})
                except Exception:  # noqa: BLE001, S112
                    continue

    return paths.where("path is not null and content is not null").select("path", "content").mapInPandas(read, schema)


def settings(*paths: str) -> dict:
    """Settings of the first file that exists, keys without regard to case; {} when there is none."""

    def low(x):
        return {k.lower(): low(v) for k, v in x.items()} if isinstance(x, dict) else x

    for p in paths:
        if Path(p).exists():
            return low(json.loads(Path(p).read_text(encoding="utf-8")))
    return {}


def encoder_settings(root: dict, generation: dict | None = None) -> dict[str, int]:
    """Sizes and special tokens of a sequence model. Token settings: generation before root before decoder, else 2; the longest
    output: generation before decoder."""
    dec, enc, gen = root["decoder"], root["encoder"], generation or {}
    number = lambda v: isinstance(v, int) and not isinstance(v, bool)
    pick = lambda k: next((d[k] for d in (gen, root, dec) if number(d.get(k))), 2)
    return {
        "layers": dec["decoder_layers"], "heads": dec["decoder_attention_heads"], "head_dim": dec["d_model"] // dec["decoder_attention_heads"], "vocabulary": dec["vocab_size"],
        "hidden": enc["hidden_size"], "sequence": (enc["image_size"] // enc["patch_size"]) ** 2 + 1, "longest": gen["max_length"] if number(gen.get("max_length")) else dec["max_length"],
        "start": pick("decoder_start_token_id"), "end": pick("eos_token_id"),
    }
