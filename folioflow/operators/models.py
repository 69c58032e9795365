"""Recognition models as plug-ins, run in Arrow batches with one session per worker.

A plug-in is registered under a name with a factory; the factory runs once per Python worker and returns a callable from
a list of inputs to a list of (text, score). ``stub`` ships for tests; ``onnx_lines`` runs a line model that the caller
supplies. Failures become the column ``error`` and never end the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster

Recognizer = Callable[[list[Any]], list[tuple[str, float]]]
_FACTORIES: dict[str, Callable[..., Recognizer]] = {}
_SESSIONS: dict[tuple, Recognizer] = {}


def register(name: str, factory: Callable[..., Recognizer]) -> None:
    _FACTORIES[name] = factory


@dataclass(frozen=True)
class Plugin:
    name: str
    options: tuple[tuple[str, Any], ...] = field(default=())
    factory: Callable[..., Recognizer] | None = None

    def session(self) -> Recognizer:
        """The worker's session of this plug-in, made on first use."""
        key = (self.name, self.options)
        if key not in _SESSIONS:
            _SESSIONS[key] = (self.factory or _FACTORIES[self.name])(**dict(self.options))
        return _SESSIONS[key]


def stub(prefix: str = "") -> Recognizer:
    """Returns text inputs unchanged with full score; images give their size."""
    return lambda xs: [(f"{prefix}{x}", 1.0) if isinstance(x, str) else ("", 0.0) if x is None else (f"{prefix}{x.shape[1]}x{x.shape[0]}", 1.0) for x in xs]


register("stub", stub)


def providers() -> list[str]:
    """The GPU where the runtime has it, else the CPU."""
    import onnxruntime as ort

    have = ort.get_available_providers()
    return [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in have]


def onnx_session(path: str):
    import onnxruntime as ort

    o = ort.SessionOptions()
    o.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
    return ort.InferenceSession(path, o, providers=providers())


def symbols(path: str, space: bool = False, keep_blank: bool = True) -> list[str]:
    """One symbol a line; blank lines count, as positions are class numbers, unless they are to be dropped."""
    with open(path, encoding="utf-8") as f:
        rows = [x.rstrip("\r\n") for x in f]
    rows = rows if keep_blank else [x.strip() for x in rows if x.strip()]
    return rows + [" "] if space else rows


def onnx_lines(model: str, dictionary: str, space: bool = False, height: int = 48, width: int = 1280) -> Recognizer:
    """Line recognizer with a timestep output."""
    run, names = onnx_session(model), symbols(dictionary, space)
    entry = run.get_inputs()[0].name

    def read(images: list[Any]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("", 0.0)] * len(images)
        have = [i for i, x in enumerate(images) if x is not None and min(x.shape[:2]) > 0]
        if have:
            for i, probs in zip(have, run.run(None, {entry: raster.recognizer_batch([images[i] for i in have], height, width)})[0]):
                best = probs.argmax(-1)
                emit = (best != 0) & np.concatenate([[True], best[1:] != best[:-1]])
                text = "".join(names[c - 1] for c in best[emit] if c - 1 < len(names))
                out[i] = (text, float(probs.max(-1)[emit].mean()) if emit.any() else 0.0)
        return out

    return read


register("onnx_lines", onnx_lines)


def recognize(rows: DataFrame, column: str, plugin: Plugin, decode: Callable[[Any], Any] | None = None) -> DataFrame:
    """Add text, score and error from a plug-in over ``column``, in Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``)."""

    @F.pandas_udf("text string, score double, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            xs = list(s)
            try:
                session = plugin.session()
                got = session([decode(x) if decode else x for x in xs])
                yield pd.DataFrame({"text": [t for t, _ in got], "score": [float(v) for _, v in got], "error": [None] * len(xs)})
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame({"text": [""] * len(xs), "score": [0.0] * len(xs), "error": [f"{type(e).__name__}: {e}"] * len(xs)})

    return rows.withColumn("_r", run(F.col(column))).select(*rows.columns, "_r.text", "_r.score", "_r.error") if "text" not in rows.columns else rows.withColumn("_r", run(F.col(column))).select(*[c for c in rows.columns if c != "text"], "_r.text", "_r.score", "_r.error")
