"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Hint a broadcast only when the measured row count is within ``max_rows``; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


#: ISO 639 codes (two and three letters) of the eleven languages.
LANG_CODES = {
    "en": "en", "eng": "en", "ru": "ru", "rus": "ru", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr",
    "es": "es", "spa": "es", "uk": "uk", "ukr": "uk", "zh": "zh", "zho": "zh", "chi": "zh", "ja": "ja", "jpn": "ja",
    "hi": "hi", "hin": "hi", "ar": "ar", "ara": "ar", "th": "th", "tha": "th",
}
LANGS = ("en", "ru", "de", "fr", "es", "uk", "zh", "ja", "hi", "ar", "th")
