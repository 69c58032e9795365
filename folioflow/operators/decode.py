"""Decoding of recognizer output: timesteps, index sequences, byte-level tokens, and characters shared out over spans."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ctc(steps: DataFrame, keys: list[str], t: str, probs: str, symbols: list[str]) -> DataFrame:
    """Greedy decoding of one row per timestep: the best class (first on ties), blanks (0) and repeats removed.

    (keys, text, score): the score is the mean probability of emitted steps, 0 without any. Classes beyond the symbols
    count for the score and give no text.
    """
    top = F.array_max(probs)
    s = steps.select(*keys, F.col(t).alias("_t"), (F.array_position(probs, top) - 1).cast("int").alias("_c"), top.cast("double").alias("_p"))
    s = s.withColumn("_e", (F.col("_c") != 0) & ~F.coalesce(F.lag("_c").over(Window.partitionBy(*keys).orderBy("_t")) == F.col("_c"), F.lit(False)))
    names = F.array(*[F.lit(x) for x in symbols])
    sign = F.when(F.col("_e"), F.struct("_t", F.coalesce(F.get(names, F.col("_c") - 1), F.lit("")).alias("s")))
    return s.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(sign)), lambda x: x["s"]), "").alias("text"), F.coalesce(F.avg(F.when(F.col("_e"), F.col("_p"))), F.lit(0.0)).alias("score"))


def ctc_spaced(steps: DataFrame, keys: list[str], t: str, probs: str, symbols: list[str], blanks: int) -> DataFrame:
    """The same with a space where at least ``blanks`` blanks stand before a sign inside the text; never two in a row."""
    top = F.array_max(probs)
    s = steps.select(*keys, F.col(t).alias("_t"), (F.array_position(probs, top) - 1).cast("int").alias("_c"))
    names = F.array(*[F.lit(x) for x in symbols])
    g = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", F.col("_c").alias("c"), F.coalesce(F.get(names, F.col("_c") - 1), F.lit("")).alias("s")))).alias("st"))
    state = "struct<text:string,run:int,last:int>"
    fold = f"""aggregate(st, cast(named_struct('text', '', 'run', 0, 'last', 0) as {state}), (a, x) ->
        if(x.c = 0, cast(named_struct('text', a.text, 'run', a.run + 1, 'last', 0) as {state}),
           cast(named_struct('text', if(x.c = a.last, a.text, concat(a.text, if(a.run >= {blanks} and a.text <> '' and not a.text like '% ', ' ', ''), x.s)), 'run', 0, 'last', x.c) as {state})),
        a -> a.text)"""
    return g.select(*keys, F.expr(fold).alias("text"))


def indexes_to_text(indexes: Column, symbols: list[str]) -> Column:
    """Valid indexes to symbols, trimmed."""
    names = F.array(*[F.lit(x) for x in symbols])
    return F.trim(F.array_join(F.filter(F.transform(indexes, lambda i: F.when(i >= 0, F.get(names, i))), lambda x: x.isNotNull()), ""))


def greedy_tokens(step, start: int, end: int, longest: int) -> list[int]:
    """Greedy sequence: ``step(tokens) -> scores`` until the end token or the greatest length; the start token is dropped."""
    tokens = [start]
    while len(tokens) < longest:
        scores = step(tokens)
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        if best == end:
            break
        tokens.append(best)
    return tokens[1:]


@lru_cache(maxsize=1)
def byte_signs() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: visible bytes stand for themselves, others follow from 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens_to_text(ids: list[int], vocabulary: dict[int, str]) -> str:
    """Byte-level tokens to text; control tokens such as ``<s>`` are skipped."""
    signs = byte_signs()
    out = bytearray()
    for i in ids:
        t = vocabulary.get(i, "")
        if len(t) >= 3 and t[0] == "<" and t[-1] == ">" and " " not in t:
            continue
        for ch in t:
            out += bytes([signs[ch]]) if ch in signs else ch.encode()
    return out.decode("utf-8", "replace").strip()


def load_vocabulary(path: str) -> dict[int, str]:
    """Token to id JSON, inverted; a missing file is an empty vocabulary."""
    try:
        with open(path, encoding="utf-8") as f:
            return {int(i): t for t, i in json.load(f).items()}
    except FileNotFoundError:
        return {}


def share_out(text: str | None, widths: list[float] | None) -> str:
    """Share the characters of a text over spans by width, at least one each, by largest remainders (ties to the first).

    Where narrow spans take more than there is, the spans furthest under their share give back, never their last one. Spans
    beyond the number of characters get none. Parts are joined by spaces. Fewer than two spans, or spans without width, leave
    the text whole; no text gives ''.
    """
    text, widths = text or "", list(widths or [])
    n, total = len(text), sum(widths)
    if not n or len(widths) < 2 or total <= 0:
        return text
    quotas = [w / total * n for w in widths]
    counts = [max(1, int(q)) for q in quotas]
    rest = [q - c for q, c in zip(quotas, counts)]
    extra = n - sum(counts)
    step = 1 if extra > 0 else -1
    heap = [(-step * r, i) for i, r in enumerate(rest) if step > 0 or counts[i] > 1]
    heapq.heapify(heap)
    for _ in range(abs(extra)):
        if not heap:
            break
        r, i = heapq.heappop(heap)
        counts[i] += step
        if step > 0 or counts[i] > 1:
            heapq.heappush(heap, (r + 1, i))
    parts, at = [], 0
    for c in counts:
        if at >= n:
            break
        parts.append(text[at : at + c])
        at += c
    if at < n:
        parts[-1] += text[at:]
    return " ".join(parts)


def shared_out(text: Column, widths: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([share_out(a, None if b is None else list(b)) for a, b in zip(t, w)])

    return run(text, widths)


def join_parts(parts: DataFrame, keys: list[str], no: str, trim: bool = True, keep: list[str] = ()) -> DataFrame:
    """Texts of windows or words of a line joined by spaces; blank ones leave; score is the mean of the others, 0 without.

    ``keep``: further columns, the same for all parts of a line.
    """
    text = F.trim("text") if trim else F.col("text")
    ok = F.col("text").rlike(r"\S")
    piece = F.when(ok, F.struct(F.col(no), text.alias("t")))
    return parts.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in keep], F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), " ").alias("text"), F.coalesce(F.avg(F.when(ok, F.col("score").cast("double"))), F.lit(0.0)).alias("score"))
