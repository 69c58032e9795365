"""The scalar functions as temporary SQL functions, and the tables as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (arguments, result, body)
FUNCTIONS = {
    "box_iou": ("a struct<x:double,y:double,w:double,h:double>, b struct<x:double,y:double,w:double,h:double>", "double", "try_divide(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0D) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0D), a.w * a.h + b.w * b.h - greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0D) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0D))"),
    "upper_ratio": ("t string", "double", r"if(length(t) > 0, regexp_count(t, '\\p{Lu}') / length(t), 1D)"),
    "unprintable_ratio": ("t string", "double", r"if(length(t) > 0, regexp_count(t, '[\\p{Cc}\\x{FFFD}]') / length(t), 1D)"),
    "file_stem": ("p string", "string", r"regexp_extract(p, '([^/]+?)(?:\\.[^./]*)?$', 1)"),
    "clamp01": ("v double", "double", "least(greatest(v, 0D), 1D)"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {result} return {body}")
    return list(FUNCTIONS)


def views(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
