"""Sinks: nested JSON (with lines, or simple) and plain text per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from .files import folder, stem


def rounded(x: Column, n: int) -> Column:
    """Half-even rounding."""
    return F.bround(x, n)


def json_box(b: Column) -> Column:
    return F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("width"), b["h"].alias("height"))


def documents(blocks: DataFrame, keys: list[str], order: list[str], seconds: Column | None = None, detailed: bool = True) -> DataFrame:
    """(keys, json): one nested JSON text per document; null fields are left out.

    ``blocks``: keys, order columns, input_file, processed_at, label, confidence, box, lines array<struct<text, box>>.
    """
    seconds = None if seconds is None else F.when(~F.isnan(seconds), seconds)
    lines = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), json_box(x["box"]).alias("box")))
    body = lines.alias("lines") if detailed else Q.accumulate(F.transform("lines", lambda x: x["text"])).alias("text")
    # a document without blocks comes as one row without a box
    one = F.when(F.col("box").isNotNull() | (F.size("lines") > 0), F.struct(*order, F.struct(F.col("label"), rounded(F.col("confidence"), 4).alias("confidence"), json_box(F.col("box")).alias("box"), body).alias("b")))
    g = blocks.groupBy(*keys).agg(F.any_value("input_file").alias("inputFile"), F.any_value("processed_at").alias("processedAt"), F.max(seconds if seconds is not None else F.lit(None).cast("double")).alias("s"), F.array_sort(F.collect_list(one)).alias("bs"))
    doc = F.struct("inputFile", "processedAt", rounded(F.col("s"), 2).alias("elapsedSeconds"), F.size("bs").alias("blockCount"), F.transform("bs", lambda x: x["b"]).alias("blocks"))
    return g.select(*keys, F.to_json(doc, {"pretty": "true"}).alias("json"))


def plain_text(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, text): blocks' texts a blank line apart; blank ones leave. ``blocks`` has lines as array<string>."""
    piece = F.concat(Q.accumulate(F.col("lines")), F.lit("\n"))
    g = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, piece.alias("p")))).alias("ps"))
    return g.select(*keys, F.array_join(F.filter(F.transform("ps", lambda x: x["p"]), lambda p: p.rlike(r"\S")), "\n").alias("text"))


def output_name(path: Column, kind: str) -> Column:
    """Name of a document's output beside its input: ``<stem>_extracted.json``, ``_extracted_simple.json`` or ``_extracted.txt``."""
    ending = {"json": "_extracted.json", "simple": "_extracted_simple.json", "text": "_extracted.txt"}[kind]
    return F.concat(folder(path), F.when(folder(path) == "", F.lit("")).otherwise(F.lit("/")), stem(path), F.lit(ending))


def write_documents(docs: DataFrame, path: str, body: str, name: str) -> None:
    """All documents as rows of few files: (name, body). One object per document is left to ``write_files``."""
    docs.select(F.col(name).alias("name"), F.col(body).alias("body")).write.mode("overwrite").parquet(path)


def write_files(docs: DataFrame, root: str, body: str, name: str) -> None:
    """One file per document under ``root``, named by ``name``, written by the workers; for folders that all of them share."""

    def write(batches):
        from pathlib import Path

        for b in batches:
            for n, t in zip(b["name"], b["body"]):
                target = Path(root) / n.lstrip("/")
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(f".{target.name}.part")
                part.write_text(t, encoding="utf-8")
                part.replace(target)  # whole or not at all, also when a task runs again
            yield b[["name"]]

    docs.select(F.col(name).alias("name"), F.col(body).alias("body")).mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
