"""Problem 9: mix sources to target shares of tokens, with capped repetition.

Tokens are those of a public byte-level tokenizer whose path is a parameter. ``water_fill`` gives every source its share
of the wanted total, clamps sources at what their repetition cap allows and hands the rest to the others in proportion,
until nothing exceeds its cap. The queries want as many tokens as the sources hold, so small sources are clamped and their
excess goes to the others; without a wanted total the largest one at which every share is met is taken. A source's
amount is then so many whole repetitions of all its records plus a seeded part of them: a histogram of the records'
hash buckets finds the bucket in which the wanted tokens are reached, and only that bucket is ordered record by record.

Records of sources without a target (or null) are not used; null and empty texts have zero tokens and come with the
whole repetitions only. A source with a target but no tokens gets nothing, and its share goes to the others. Repeated
rows of a ``doc_id`` count once. The token counts and the choice cover all rows. More than ``Params.max_sources`` targets
raise an error: the amounts are worked out on the driver, one row per source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import written
from .common import table

#: Fixed value: the pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Params:
    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    seed: int = 17
    buckets: int = 1 << 16
    max_sources: int = 10_000  # rows of the target table that may be held at once


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, p: Params = Params()) -> DataFrame:
    """Add ``tokens`` and drop the text."""
    path = p.tokenizer

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn("tokens", tokens(F.col(text))).drop(text)


def water_fill(targets: dict[str, tuple[float, float]], totals: dict[str, int], wanted: float | None = None) -> dict[str, float]:
    """Amounts per source. ``targets``: source -> (share, greatest repetition)."""
    live = {s: (w, totals.get(s, 0) * m) for s, (w, m) in targets.items() if w and w > 0 and totals.get(s, 0) * (m or 0) > 0}
    out = {s: 0.0 for s in targets}
    if not live:
        return out
    if wanted is None:
        whole = sum(w for w, _ in live.values())
        wanted = min(cap * whole / w for w, cap in live.values())
    left = float(wanted)
    while live and left > 0:
        unit = left / sum(w for w, _ in live.values())
        full = [s for s, (w, cap) in live.items() if w * unit >= cap]
        if not full:
            for s, (w, _) in live.items():
                out[s] = w * unit
            break
        for s in full:
            out[s] = live.pop(s)[1]
            left -= out[s]
    return out


def sizes(spark: SparkSession, sf_dir: str, p: Params) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Token counts of the records of targeted sources, and the targets."""
    rows = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").where("source is not null").limit(p.max_sources + 1).collect()
    if len(rows) > p.max_sources:
        raise ValueError("more sources than max_sources")
    targets = {r.source: (float(r.target_share or 0), float(r.max_repeats or 0)) for r in rows}
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").where(F.col("doc_id").isNotNull() & F.col("source").isin(*targets))
    counted = count_tokens(docs, "text", p).groupBy("doc_id").agg(F.max_by("source", "tokens").alias("source"), F.max("tokens").alias("tokens"))
    return written(counted, "tokens"), targets


def choose(tok: DataFrame, amounts: dict[str, float], totals: dict[str, int], p: Params) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the chosen records."""
    spark = tok.sparkSession
    plan = []
    for s, a in amounts.items():
        if totals.get(s):
            epochs = a / totals[s]
            whole = int(epochs + 1e-9)
            plan.append((s, whole, max(0.0, a - whole * totals[s])))
    if not plan:
        return tok.withColumn("repeats", F.lit(0)).limit(0)
    plans = F.broadcast(spark.createDataFrame(plan, "source string, whole int, part double"))  # one row per target
    h = F.xxhash64("doc_id", F.lit(p.seed))
    t = tok.join(plans, "source").withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(p.buckets)))
    per = t.groupBy("source", "bucket", "part").agg(F.sum("tokens").alias("b"))
    run = F.sum("b").over(Window.partitionBy("source").orderBy("bucket"))
    edge = per.withColumn("upto", run).where((F.col("upto") > F.col("part")) & (F.col("upto") - F.col("b") <= F.col("part")))
    edge = F.broadcast(edge.groupBy("source").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("b"), "bucket").alias("before")))  # one row per target
    t = t.join(edge, "source", "left")
    inside = t.where("bucket = edge").withColumn("at", F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    taken = inside.select("doc_id", "source", "tokens", "whole", ((F.col("before") + F.col("at") - F.col("tokens") / 2) <= F.col("part")).alias("extra"))
    rest = t.where("edge is null or bucket <> edge").select("doc_id", "source", "tokens", "whole", F.when(F.col("edge").isNull(), F.col("part") > 0).otherwise(F.col("bucket") < F.col("edge")).alias("extra"))
    out = taken.unionByName(rest).select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra").cast("int")).alias("repeats"))
    return out.where("repeats > 0")


def mixture(spark: SparkSession, sf_dir: str, wanted_share: float | None = None, p: Params = Params()) -> tuple[DataFrame, dict[str, tuple[float, float]], dict[str, int]]:
    tok, targets = sizes(spark, sf_dir, p)
    totals = {r.source: int(r.n or 0) for r in tok.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row per target
    wanted = None if wanted_share is None else wanted_share * sum(totals.values())
    return choose(tok, water_fill(targets, totals, wanted), totals, p), targets, totals


WANTED = 1.0  # wanted total of the queries, as a share of all tokens of the targeted sources


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen records with repeats when as many tokens are wanted as the sources hold: sources at their cap leave their excess to others."""
    return mixture(spark, sf_dir, WANTED)[0]


def _shares(spark: SparkSession, sf_dir: str, wanted_share: float | None) -> DataFrame:
    mix, targets, totals = mixture(spark, sf_dir, wanted_share)
    goal = spark.createDataFrame([(s, w, m, totals.get(s, 0)) for s, (w, m) in targets.items()], "source string, target_share double, max_repeats double, available bigint")
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("repeats").alias("most_repeats"))
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    return goal.join(got, "source", "left").select("source", "target_share", "max_repeats", "available", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce("tokens", F.lit(0)) / F.nullif(all_tokens, F.lit(0)), 6).alias("actual_share"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in ``p9_mix``."""
    return _shares(spark, sf_dir, WANTED)


def p9_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the largest total that meets all shares."""
    return _shares(spark, sf_dir, None)
