"""Clustering of boxes on a page: nearest neighbours, distance thresholds, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import stats as S
from .raster import closed


def whole_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch], schema: str, order: list[str] = ()) -> DataFrame:
    """Run ``work`` on tables that hold whole groups, in the order of the keys; a group never spans two tables.

    Groups are pages, regions or blocks, whose size is bounded by what a page holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)  # rows that open a group
            same = np.ones(b.num_rows - 1, bool)
            for k in keys:
                c = b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                same &= c[1:] == c[:-1]
            new[1:] = ~same
            new[0] = not held or any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != b.column(k)[0].as_py() for k in keys)
            opens = np.flatnonzero(new)
            if len(opens):
                done = [*held, b.slice(0, int(opens[-1]))]
                if sum(x.num_rows for x in done):
                    yield work(pa.Table.from_batches(done).combine_chunks())
                held = [b.slice(int(opens[-1]))]
            else:
                held.append(b)
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _bounds(part: pa.Table, keys: list[str]) -> np.ndarray:
    """Bounds of the groups of a table ordered by its keys."""
    if not part.num_rows:
        return np.zeros(1, np.int64)
    new = np.zeros(part.num_rows, bool)
    new[0] = True
    for k in keys:
        c = part[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), part.num_rows)


BLOCK_ROWS = 512  # boxes of a group whose distances are held at once


def _nearest(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(positions a, positions b, distance, rank) of the ``k`` nearest boxes of each box of one group, by blocks of rows."""
    size = len(x)
    n = min(k, size - 1)
    for at in range(0, size if n > 0 else 0, BLOCK_ROWS):
        r = slice(at, min(at + BLOCK_ROWS, size))
        dx = np.maximum(0.0, np.maximum(x[r, None] - (x + w), x - (x[r, None] + w[r, None])))
        dy = np.maximum(0.0, np.maximum(y[r, None] - (y + h), y - (y[r, None] + h[r, None])))
        d = np.sqrt(dx * dx + dy * dy)
        rows = np.arange(r.stop - r.start)
        d[rows, rows + at] = np.inf
        edge = np.partition(d, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero(d <= edge[:, None])
        best = np.lexsort((ids[j], d[i, j], i))
        i, j = i[best], j[best]
        no = np.arange(len(i)) - np.searchsorted(i, i)
        keep = no < n
        yield i[keep] + at, j[keep], d[i[keep], j[keep]], no[keep] + 1


def neighbours(boxes: DataFrame, keys: list[str], idx: str, k: int) -> DataFrame:
    """(keys, a, b, distance, angle, box_a, box_b): the ``k`` nearest boxes of each box of its group; ties to the earlier index.

    The boxes of a group meet once and distances are worked out in blocks of rows, so no pair but the nearest leaves the
    worker. Boxes of an unknown group, or without a box, have no neighbours.
    """
    src = boxes.where(" and ".join(f"`{x}` is not null" for x in keys) + " and box is not null").select(*keys, F.col(idx).cast("bigint").alias("a"), *[F.col(f"box.{c}").cast("double").alias(c) for c in "xywh"])
    kinds = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", a bigint, b bigint, rank int, distance double, ia int, ib int, ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double"

    def nearest(part: pa.Table) -> pa.RecordBatch:
        ids = part["a"].to_numpy()
        x, y, w, h = (np.nan_to_num(part[c].to_numpy(), nan=0.0) for c in "xywh")
        left, right, dist, rank = [], [], [], []
        bounds = _bounds(part, keys)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            for i, j, d, no in _nearest(*(v[lo:hi] for v in (x, y, w, h, ids)), k):
                left.append(i + lo)
                right.append(j + lo)
                dist.append(d)
                rank.append(no)
        a, b = (np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64) for z in (left, right))
        cols = [part[c].take(pa.array(a)).combine_chunks() for c in keys]
        cols += [pa.array(ids[a]), pa.array(ids[b]), pa.array(np.concatenate(rank).astype(np.int32) if rank else np.zeros(0, np.int32)), pa.array(np.concatenate(dist) if dist else np.zeros(0))]
        cols += [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *(pa.array(v[i]) for i in (a, b) for v in (x, y, w, h))]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "a", "b", "rank", "distance", "ia", "ib", "ax", "ay", "aw", "ah", "bx", "by", "bw", "bh"])

    n = whole_groups(src, keys, nearest, schema, ["a"])
    box = lambda p: F.struct(*[F.col(p + c).alias(c) for c in "xywh"])
    n = n.select(*keys, "a", "b", "rank", "distance", box("a").alias("box_a"), box("b").alias("box_b"))
    return n.withColumn("angle", G.angle(F.col("box_a"), F.col("box_b")))


def word_edges(boxes: DataFrame, keys: list[str], idx: str, k: int = 5, across: float = 2.5, down: float = 1.6) -> DataFrame:
    """Edges (keys, a, b) between words of a group that stand close: by the medians of horizontal and vertical neighbour distances.

    Where a direction has no neighbours, a fifth of (across) or one (down) average box height is the limit's base.
    """
    n = neighbours(boxes, keys, idx, k).withColumn("flat", G.is_horizontal(F.col("angle")))
    base = boxes.groupBy(*keys).agg(F.avg("box.h").alias("height"))
    med = n.groupBy(*keys).agg(S.median(F.collect_list(F.when(F.col("flat"), F.col("distance")))).alias("mh"), S.median(F.collect_list(F.when(~F.col("flat"), F.col("distance")))).alias("mv"))
    lim = med.join(base, keys).select(*keys, F.when(F.col("mh") > 0, F.col("mh") * across).otherwise(F.col("height") * 0.2).alias("th"), F.when(F.col("mv") > 0, F.col("mv") * down).otherwise(F.col("height")).alias("tv"))
    e = n.join(lim, keys)
    near = (F.col("flat") & (F.col("distance") <= F.col("th"))) | (~F.col("flat") & (F.col("distance") <= F.col("tv")) & G.overlaps_x(F.col("box_a"), F.col("box_b")))
    return e.where(near).select(*keys, "a", "b")


def natural_breaks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, break_at, p90): two-class natural break and nearest-rank 90th percentile per group, by running sums.

    Fewer than ten values: 1.2 times the greatest; no clear gap at the best cut: the percentile.
    """
    whole = Window.partitionBy(*keys)
    sorted_ = whole.orderBy(value)
    upto = sorted_.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull()).select(*keys, v.alias(value))
    d = d.select(*keys, F.col(value).alias("_v"), F.row_number().over(sorted_).alias("_i"), F.count(F.lit(1)).over(whole).alias("_n"), F.sum(value).over(upto).alias("_s"), F.sum(F.col(value) * F.col(value)).over(upto).alias("_q"), F.sum(value).over(whole).alias("_t"), F.sum(F.col(value) * F.col(value)).over(whole).alias("_u"), F.lead(value).over(sorted_).alias("_x"))
    c = F.col
    least = F.greatest(F.lit(2), F.floor(c("_n") / 10))
    wss = F.round(c("_q") - c("_s") * c("_s") / c("_i") + (c("_u") - c("_q")) - (c("_t") - c("_s")) * (c("_t") - c("_s")) / F.nullif(c("_n") - c("_i"), F.lit(0)), 6)
    cut = F.when((c("_i") >= least) & (c("_i") <= F.greatest(c("_n") - least, least)) & (c("_i") < c("_n")), F.struct(wss.alias("w"), c("_i").alias("i"), c("_v").alias("lo"), c("_x").alias("hi")))
    rank = F.when(c("_i") == F.least(c("_n") - 1, F.floor(c("_n") * 0.9)) + 1, c("_v"))
    g = d.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_v").alias("_top"), F.min(cut).alias("_c"), F.max(rank).alias("p90"))
    at = F.when(c("_n") < 10, c("_top") * 1.2).when(c("_c.hi") >= 2 * F.greatest(F.lit(1.0), c("_c.lo")), (c("_c.hi") + c("_c.lo")) / 2).otherwise(c("p90"))
    return g.select(*keys, at.alias("break_at"), "p90")


def component_edges(boxes: DataFrame, keys: list[str], idx: str, k: int = 10, gaps: DataFrame | None = None) -> DataFrame:
    """Edges between components of a raster: 90th percentile across, natural break down; none across a column gap.

    ``gaps``: (keys, gaps) with an array of column gaps (l, r) of the group, or none. Without neighbours in a direction the limit is 1.5
    (across) or 2 (down) average heights.
    """
    n = neighbours(boxes, keys, idx, k).withColumn("flat", G.is_horizontal(F.col("angle")))
    across = natural_breaks(n.where("flat"), keys, "distance").select(*keys, F.col("p90").alias("_th"))
    down = natural_breaks(n.where("not flat"), keys, "distance").select(*keys, F.col("break_at").alias("_tv"))
    lim = boxes.groupBy(*keys).agg(F.avg("box.h").alias("_h")).join(across, keys, "left").join(down, keys, "left")
    lim = lim.select(*keys, F.when(F.col("_th") > 0, F.col("_th")).otherwise(F.col("_h") * 1.5).alias("th"), F.when(F.col("_tv") > 0, F.col("_tv")).otherwise(F.col("_h") * 2.0).alias("tv"))
    e = n.join(lim, keys) if gaps is None else n.join(lim, keys).join(gaps.select(*keys, "gaps"), keys, "left")
    ca, cb = F.col("box_a.x") + F.col("box_a.w") / 2, F.col("box_b.x") + F.col("box_b.w") / 2
    crosses = F.lit(False) if gaps is None else F.coalesce(F.exists("gaps", lambda g: ((g["l"] + g["r"]) / 2 > F.least(ca, cb)) & ((g["l"] + g["r"]) / 2 < F.greatest(ca, cb))), F.lit(False))
    near = (F.col("flat") & (F.col("distance") <= F.col("th")) & ~crosses) | (~F.col("flat") & (F.col("distance") <= F.col("tv")) & G.overlaps_x(F.col("box_a"), F.col("box_b")))
    return e.where(near).select(*keys, "a", "b")


def _rounded(x: float) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP)


def breaks_of(values: np.ndarray) -> tuple[float, float]:
    """(break_at, p90) as ``natural_breaks`` gives them, of the values of one group; 0 without any."""
    v = np.sort(values)
    n = len(v)
    if not n:
        return 0.0, 0.0
    p90 = float(v[min(n - 1, int(n * 0.9))])
    if n < 10:
        return float(v[-1]) * 1.2, p90
    s, q = np.cumsum(v), np.cumsum(v * v)
    least = max(2, n // 10)
    i = np.arange(least, max(n - least, least) + 1)
    t, u, s, q = s[-1], q[-1], s[i - 1], q[i - 1]
    wss = q - s * s / i + (u - q) - (t - s) * (t - s) / (n - i)
    near = np.flatnonzero(wss <= wss.min() + 2e-6)  # only these can be least once they are rounded
    at = int(i[min(near, key=lambda z: (_rounded(float(wss[z])), z))])
    lo, hi = float(v[at - 1]), float(v[at])
    return (hi + lo) / 2 if hi >= 2 * max(1.0, lo) else p90, p90


def component_groups(boxes: np.ndarray, gaps: list[tuple[float, float]] = (), k: int = 10) -> np.ndarray:
    """The groups of one raster's components, (n, 4) of x, y, w, h, inside a worker: what ``groups`` makes of ``component_edges``.

    Each component has the position of the first of its group.
    """
    label = np.arange(len(boxes))
    x, y, w, h = boxes.T.astype(np.float64)
    near = list(_nearest(x, y, w, h, label, k))
    if not near:
        return label
    a, b, d, _ = (np.concatenate(z) for z in zip(*near))
    ca, cb, ma, mb = x[a] + w[a] / 2, x[b] + w[b] / 2, y[a] + h[a] / 2, y[b] + h[b] / 2
    angle = np.abs(np.degrees(np.arctan2(mb - ma, cb - ca)))
    flat = (angle <= 40) | (angle >= 140)
    across, down = breaks_of(d[flat])[1], breaks_of(d[~flat])[0]
    th, tv = across if across > 0 else h.mean() * 1.5, down if down > 0 else h.mean() * 2.0
    joined = np.where(flat, d <= th, (d <= tv) & (x[a] <= x[b] + w[b]) & (x[b] <= x[a] + w[a]))
    for l, r in gaps:
        joined &= ~flat | ((l + r) / 2 <= np.minimum(ca, cb)) | ((l + r) / 2 >= np.maximum(ca, cb))
    return closed(label, a[joined], b[joined])


def groups(nodes: DataFrame, edges: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Connected groups: each node with the least index of its group.

    Nodes and edges of a group meet once, and all groups of a table are closed together by spreading least labels, so there
    is no call per page. Nodes of an unknown group stand alone.
    """
    known = " and ".join(f"`{k}` is not null" for k in keys)
    own = nodes.select(*keys, F.col(idx).cast("bigint").alias("a"))
    both = own.where(known).withColumn("b", F.col("a")).unionByName(edges.where(known).select(*keys, F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))
    kinds = dict(both.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{idx}` bigint, cluster bigint"

    def close(part: pa.Table) -> pa.RecordBatch:
        """Labels of all nodes of a table that holds whole groups."""
        bounds = _bounds(part, keys)
        code = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        a, b = part["a"].to_numpy(), part["b"].to_numpy()
        own = np.flatnonzero(a == b)
        own = own[np.lexsort((a[own], code[own]))]  # ordered by group, then index: the least row is the least index
        own = own[np.concatenate([[True], (np.diff(code[own]) != 0) | (np.diff(a[own]) != 0)])] if len(own) else own
        pos = {x: i for i, x in enumerate(zip(code[own].tolist(), a[own].tolist()))}
        link = np.flatnonzero(a != b)
        x = np.array([pos[k] for k in zip(code[link].tolist(), a[link].tolist())], np.int64)
        y = np.array([pos[k] for k in zip(code[link].tolist(), b[link].tolist())], np.int64)
        label = closed(np.arange(len(own)), x, y)
        rows = pa.array(own)
        return pa.RecordBatch.from_arrays([*[part[k].take(rows).combine_chunks() for k in keys], pa.array(a[own]), pa.array(a[own][label])], names=[*keys, idx, "cluster"])

    out = whole_groups(both, keys, close, schema)
    return out.unionByName(own.where(f"not ({known})").distinct().select(*keys, F.col("a").alias(idx), F.col("a").alias("cluster")))
