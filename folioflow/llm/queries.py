"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canonical, langid, leakage, mixing, ocrfix, pii, qdigest, sentences, textstats, truncation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    modules = (langid, pii, textstats, sentences, ocrfix, qdigest, canonical, leakage, mixing, truncation)
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for n, m in enumerate(modules, 1):
        names = [k for k in vars(m) if k.startswith(f"p{n}_")]
        for k in sorted(names, key=lambda k: (k != f"p{n}_found", names.index(k))):
            out[k] = getattr(m, k)
    return out


def oracle_sql() -> dict[str, str]:
    return {k: s for m in (qdigest, textstats, truncation) for k, s in m.oracle_sql().items()}
