"""Pixel kernels in numpy. Images are (height, width, channels) uint8 in RGB, or (height, width) grey."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from ..schema import PreprocessOptions


def luma(img: np.ndarray) -> np.ndarray:
    """Weights 299, 587, 114."""
    return img if img.ndim == 2 else ((img[..., 0].astype(np.int64) * 299 + img[..., 1].astype(np.int64) * 587 + img[..., 2].astype(np.int64) * 114) // 1000).astype(np.uint8)


def mean_grey(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else (img[..., :3].astype(np.int64).sum(-1) // 3).astype(np.uint8)


def weighted_grey(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else np.round(img[..., 0] * 0.299 + img[..., 1] * 0.587 + img[..., 2] * 0.114).astype(np.uint8)


def over_white(rgba: np.ndarray) -> np.ndarray:
    """Composite over white."""
    a = rgba[..., 3:4].astype(np.float64) / 255
    return np.round(rgba[..., :3] * a + 255 * (1 - a)).astype(np.uint8)


def otsu_grey(grey: np.ndarray, times: np.ndarray | None = None) -> int:
    """Threshold of a grey image; 127 when there is nothing to separate. ``times``: how often each row stands."""
    if not grey.size or (lo := grey.min()) == (hi := grey.max()):
        return 127
    if ((grey == lo) | (grey == hi)).all():  # two greys part at the darker one
        return int(lo)
    h = np.bincount(grey.reshape(-1), None if times is None else np.repeat(times, grey.shape[1]), minlength=256).astype(np.float64)
    w = np.cumsum(h)
    s = np.cumsum(h * np.arange(256))
    rest = w[-1] - w
    ok = (w > 0) & (rest > 0)
    if not ok.any():
        return 127
    var = np.zeros(256)
    var[ok] = w[ok] * rest[ok] * (s[ok] / w[ok] - (s[-1] - s[ok]) / rest[ok]) ** 2
    return int(var.argmax()) if var.max() > 0 else 127


def dark(img: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Pixels darker than the threshold of the image. ``times``: how often each row stands."""
    g = luma(img)
    return g < otsu_grey(g, times)


def binarize(grey: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Ink mask by a global threshold; the darker side is ink on a light page, the lighter one on a dark page."""
    t = otsu_grey(grey, times)
    light = grey.mean() if times is None else grey.sum(1, np.int64) @ times / (times.sum() * grey.shape[1])
    return grey <= t if light >= 128 else grey > t


def bands(img: np.ndarray) -> list[int]:
    """Where rows begin that differ from the one above, and the height."""
    h = img.shape[0]
    if h < 2:
        return [0, h] if h else [0]
    return [0, *(np.flatnonzero((img[1:] != img[:-1]).any(tuple(range(1, img.ndim)))) + 1).tolist(), h]


def banded(img: np.ndarray, edges: list[int] | None = None, top: int = 0, bottom: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``img[top:bottom]``, of those that are equal one, and how often each stands. ``edges``: the image's bands."""
    edges, bottom = bands(img) if edges is None else edges, img.shape[0] if bottom is None else bottom
    e = [top, *edges[bisect_right(edges, top) : bisect_left(edges, bottom)]]
    return img[e], np.array([q - t for t, q in zip(e, [*e[1:], bottom])])


@lru_cache(maxsize=16)
def _gauss(block: int) -> np.ndarray:
    """Product with a row of ``block + 63`` samples: the Gaussian-weighted means of 64 neighbourhoods."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    out = np.zeros((block + 63, 64), np.float32)
    for j in range(64):
        out[j : j + block, j] = k / k.sum()
    return out


def _row_means(g: np.ndarray, block: int) -> np.ndarray:
    """Gaussian-weighted means along the rows, edges repeated."""
    (n, w), m = g.shape, block // 2
    tiles = -(-w // 64)
    g = np.pad(g, ((0, 0), (m, m + tiles * 64 - w)), mode="edge")
    parts = np.lib.stride_tricks.as_strided(g, (n, tiles, block + 63), (g.strides[0], 64 * g.strides[1], g.strides[1]))
    return (parts.reshape(n * tiles, -1) @ _gauss(block)).reshape(n, -1)[:, :w]


def adaptive_ink(grey: np.ndarray, block: int = 31, c: float = 10.0) -> np.ndarray:
    """Ink mask against a Gaussian-weighted neighbourhood mean, a whole number, minus ``c``; the block is made odd and at least 3."""
    block = max(3, block | 1)
    rows, times = banded(grey)
    g = _row_means(rows.astype(np.float32), block).repeat(times, 0)
    return grey <= np.rint(_row_means(g.T, block).T) - np.ceil(c)


def row_variance(grey: np.ndarray) -> float:
    """Population variance of the rows' numbers of dark pixels."""
    return _variance((grey < 128).sum(1))


def _variance(n: np.ndarray) -> float:
    return float(((n - n.sum() / len(n)) ** 2).cumsum()[-1] / len(n)) if len(n) else 0.0  # summed from top to bottom, on which equal angles depend


def _margin(h: int, w: int, degrees: float) -> int:
    """How far a rotation moves pixels at most, and two more."""
    return int(np.sin(np.deg2rad(min(abs(degrees), 180.0) / 2)) * np.hypot(h, w)) + 3


def _turned(h: int, w: int, degrees: float, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time of an image rotated about its centre: the first row, where in the source, ``m`` wider on every side, the upper left of each pixel's four neighbours lies, and its column and row in 65536ths.

    The arrays are filled anew for the next rows.
    """
    a = np.deg2rad(degrees)
    x, y = np.arange(w) - w / 2, (np.arange(h) - h / 2)[:, None]
    kind = np.int32 if max(h, w) + 2 * m < 32_768 and (h + 2 * m) * (w + 2 * m) < 2**31 else np.int64
    fixed = lambda v: np.rint(v * 65_536).astype(kind)
    sx, sy, by_x, by_y = fixed(np.cos(a) * x + w / 2 + m), fixed(np.sin(a) * x + h / 2 + m), fixed(-np.sin(a) * y), fixed(np.cos(a) * y)
    n = min(h, max(1, 32_768 // max(w, 1)))
    held = [np.empty((n, w), k) for k in (kind, kind, kind, kind, np.intp)]
    for t in range(0, h, n):
        u, v, left, up, at = (b[: h - t] for b in held)
        np.right_shift(np.add(sx, by_x[t : t + n], out=u), 16, out=left)
        np.right_shift(np.add(sy, by_y[t : t + n], out=v), 16, out=up)
        np.add(np.multiply(up, w + 2 * m, out=up), left, out=at)
        yield t, at, u, v


def _between(wide: np.ndarray, at: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Linear interpolation of four neighbours, from places as ``_turned`` gives them."""
    x, y, flat, s = u.astype(np.int64) & 65_535, v.astype(np.int64) & 65_535, wide.reshape(-1), wide.shape[1]
    upper = flat[at] * (65_536 - x) + flat[at + 1] * x
    lower = flat[at + s] * (65_536 - x) + flat[at + s + 1] * x
    return (upper * (65_536 - y) + lower * y + 2**31) >> 32


def rotate(grey: np.ndarray, degrees: float) -> np.ndarray:
    """Rotate about the centre with linear interpolation over white."""
    (h, w), m = grey.shape, _margin(*grey.shape, degrees)
    wide = np.pad(grey, m, constant_values=255)
    out = np.empty_like(grey)
    for t, at, u, v in _turned(h, w, degrees, m):
        out[t : t + len(at)] = _between(wide, at, u, v)
    return out


def skew(grey: np.ndarray, most: float = 5.0, step: float = 0.5) -> float:
    """Angle, of equal ones the first, whose rotation gives the rows' numbers of dark pixels the greatest variance.

    Only where dark and light neighbours meet is a rotated pixel interpolated: among equals it is like them.
    """
    (h, w), m = grey.shape, _margin(*grey.shape, most)
    wide = np.pad(grey, m, constant_values=255)
    dark = (wide < 128).view(np.uint8)
    near = np.zeros_like(dark)  # how many of a pixel's four neighbours are dark
    near[:-1, :-1] = dark[:-1, :-1] + dark[:-1, 1:] + dark[1:, :-1] + dark[1:, 1:]
    sort = np.array([0, 1, 1, 1, 2], np.uint8)[near].reshape(-1)  # light, mixed, dark
    best, angle, a = -1.0, 0.0, -most
    if not dark.any():
        return float(a)
    held = np.empty(max(32_768, w), np.uint8)
    while a <= most:
        rows = np.zeros(h, np.int64)
        for t, at, u, v in _turned(h, w, a, m):
            s = sort.take(at, out=held[: at.size].reshape(at.shape), mode="clip")
            n = (s == 2).sum(1)
            i = (s == 1).reshape(-1).nonzero()[0]
            i = i[_between(wide, at.reshape(-1)[i], u.reshape(-1)[i], v.reshape(-1)[i]) < 128]
            rows[t : t + len(n)] = n + np.bincount(i // w, minlength=len(n))
        if (found := _variance(rows)) > best:
            best, angle = found, a
        a += step
    return float(angle)


def preprocess(img: np.ndarray, o: PreprocessOptions = PreprocessOptions()) -> np.ndarray | None:
    """Deskewed and binarized image; None when nothing is switched on."""
    if not (o.deskew or o.binarize):
        return None
    g = weighted_grey(img)
    if o.deskew and g.shape[0] >= o.min_height and abs(a := skew(g, o.max_angle, o.step)) > o.step * 0.5:
        g = rotate(g, a)
    return np.where(adaptive_ink(g, o.block, o.c), 0, 255).astype(np.uint8) if o.binarize else g


@lru_cache(maxsize=1024)
def _taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Four sources and weights, (4, n) each, of a cubic resampling (B = C = 1/3) of m samples to n; edges are repeated."""
    src = (np.arange(n) + 0.5) * m / n - 0.5
    taps = np.floor(src).astype(int) + np.array([-1, 0, 1, 2])[:, None]
    x = np.abs(src - taps)
    w = np.where(x < 1, (7 * x**3 - 12 * x**2 + 16 / 3) / 6, np.where(x < 2, (-7 / 3 * x**3 + 12 * x**2 - 20 * x + 32 / 3) / 6, 0.0))
    return np.clip(taps, 0, m - 1), (w / w.sum(0)).astype(np.float32)


@lru_cache(maxsize=1024)
def _phases(n: int, m: int) -> np.ndarray:
    """Numbers of the samples of ``_taps`` by their weights."""
    return np.unique(_taps(n, m)[1], axis=1, return_inverse=True)[1].reshape(-1)


def resized_rows(img: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Cubic resize, separable, rows first: the rows that differ, and which of them each row is. Equal rows are made once."""
    n = img.shape[0]
    taps, weights = _taps(h, n)
    seen: dict[bytes, int] = {}
    band = np.array([seen.setdefault(r.tobytes(), len(seen)) for r in img])
    key = _phases(h, n)
    for t in taps:
        key = key * len(seen) + band[t]
    _, first, row = np.unique(key, return_index=True, return_inverse=True)
    shape = (len(first), *[1] * (img.ndim - 1))
    out = img.astype(np.float32)
    out = sum(out[t[first]] * v[first].reshape(shape) for t, v in zip(taps, weights))
    taps, weights = _taps(w, img.shape[1])
    shape = (1, w, *[1] * (img.ndim - 2))
    out = sum(np.take(out, t, axis=1) * v.reshape(shape) for t, v in zip(taps, weights))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8), row.reshape(-1)


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Cubic resize."""
    rows, row = resized_rows(img, h, w)
    return rows[row]


def upscaled(img: np.ndarray, under: int = 32, to: int = 64) -> np.ndarray:
    h, w = img.shape[:2]
    return img if h >= under or h == 0 else resize(img, to, max(1, round(w * to / h)))


def letterbox(img: np.ndarray, side: int = 640) -> tuple[np.ndarray, float, float, float]:
    """Planar float image in a grey (114) square, and scale, padding."""
    h, w = img.shape[:2]
    s = min(side / w, side / h)
    sw, sh = int(w * s), int(h * s)
    px, py = (side - sw) / 2, (side - sh) / 2
    out = np.full((side, side, 3), 114, np.uint8)
    y0, x0 = int(py), int(px)
    out[y0 : y0 + sh, x0 : x0 + sw] = resize(img[..., :3], sh, sw)
    return (out.astype(np.float32) / 255).transpose(2, 0, 1), s, px, py


def stretched(img: np.ndarray, side: int = 640) -> np.ndarray:
    return (resize(img[..., :3], side, side).astype(np.float32) / 255).transpose(2, 0, 1)


def recognizer_batch(images: list[np.ndarray], height: int = 48, most: int = 1280) -> np.ndarray:
    """Lines of one height side by side in a white-padded batch, scaled to [-1, 1]."""
    rows = [resize(i[..., :3], height, min(most, max(1, round(i.shape[1] * height / i.shape[0])))) for i in images]
    width = max(r.shape[1] for r in rows)
    out = np.full((len(rows), height, width, 3), 255, np.uint8)
    for k, r in enumerate(rows):
        out[k, :, : r.shape[1]] = r
    return ((out.astype(np.float32) / 255 - 0.5) / 0.5).transpose(0, 3, 1, 2)


def runs(on: np.ndarray, least_gap: int = 1) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of true values; runs nearer than ``least_gap`` false values are one."""
    idx = np.flatnonzero(on)
    if not len(idx):
        return []
    cut = np.flatnonzero(np.diff(idx) > least_gap)
    return [(int(a), int(b)) for a, b in zip(np.concatenate([[idx[0]], idx[cut + 1]]), np.concatenate([idx[cut], [idx[-1]]]))]


def closed(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least labels spread along the links (x, y)."""
    while len(x):
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(ink: np.ndarray, times: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """8-connected components (left, top, right, bottom, area), bounds half-open, by linking the runs of rows; equal rows in a row are one.

    ``times``: how often each row stands.
    """
    if not ink.size:
        return []
    if times is None:
        ink, times = banded(ink)
    return components_of([(ink, times)])[0]


def components_of(inks: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[int, int, int, int, int]]]:
    """The components of several ink masks, given by their bands, in one go: an empty row stands between two masks."""
    if not inks:
        return []
    w = max(i.shape[1] for i, _ in inks)
    s = w + 1  # an empty column parts the rows, laid end to end
    n = sum(len(i) for i, _ in inks) + len(inks)
    flat = np.zeros(n * s + 1, bool)
    rows = flat[1:].reshape(n, s)
    high, opens, at = np.zeros(n, np.int64), [], 0
    for i, times in inks:
        opens.append(at)
        rows[at : at + len(i), : i.shape[1]] = i
        high[at : at + len(i)] = times
        at += len(i) + 1
    ends = high.cumsum()
    turns = (flat[1:] != flat[:-1]).nonzero()[0]
    a, b = turns[::2], turns[1::2]  # the runs, half-open
    row = a // s
    left, bottom = a - row * s, ends[row]
    right, top = left + b - a, bottom - high[row]
    area = (b - a) * high[row]
    of = np.searchsorted(opens, row, "right") - 1 if len(inks) > 1 else np.zeros(len(a), np.int64)
    first, last = np.searchsorted(b, a + s), np.searchsorted(a, b + s, "right")  # those of the next row that touch a run
    k = np.maximum(last - first, 0)
    if (x := np.repeat(np.arange(len(a)), k)).size:
        y = np.arange(len(x)) - np.repeat(k.cumsum() - k, k) + first[x]
        label = closed(np.arange(len(a)), x, y)
        by = label.argsort(kind="stable")
        begin = (label[by] == by).nonzero()[0]  # a component's label is its first run
        left, top, right, bottom, area = (f.reduceat(v[by], begin) for f, v in ((np.minimum, left), (np.minimum, top), (np.maximum, right), (np.maximum, bottom), (np.add, area)))
        of = of[by[begin]]
    base = (ends[opens] - high[opens])[of]
    found = list(zip(left.tolist(), (top - base).tolist(), right.tolist(), (bottom - base).tolist(), area.tolist()))
    cut = np.searchsorted(of, range(len(inks) + 1)).tolist()
    return [found[i:j] for i, j in zip(cut, cut[1:])]


def line_strips(img: np.ndarray, pad: int = 4) -> list[tuple[int, int]]:
    """Rows (top, bottom) of text lines: components of dark pixels, small ones dropped, touching ones joined."""
    return strips_of(components(mean_grey(img) < 128), pad)


def strips_of(found: list[tuple[int, int, int, int, int]], pad: int = 4) -> list[tuple[int, int]]:
    parts = sorted((t, b) for l, t, r, b, _ in found if b - t >= 3 and r - l >= 2)
    out: list[list[int]] = []
    for t, b in parts:
        if out and t <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([t, b])
    return [(max(0, t - pad), b) for t, b in out]


def otsu_values(values: list[int]) -> int:
    if not values or max(values) == 0:
        return 0
    v, n = np.unique(np.array(values), return_counts=True)
    k, t = np.cumsum(n), np.cumsum(v * n)
    gain = k[:-1] * (k[-1] - k[:-1]) * (t[:-1] / k[:-1] - (t[-1] - t[:-1]) / (k[-1] - k[:-1])) ** 2  # only values that occur part others
    return int(v[gain.argmax()]) if len(gain) and gain.max() > 0 else 0


def _cut(segs: list[tuple[int, int]], at: list[bool]) -> list[tuple[int, int]]:
    words, start = [], 0
    for i, c in enumerate(at):
        if c:
            words.append((segs[start][0], segs[i][1]))
            start = i + 1
    words.append((segs[start][0], segs[-1][1]))
    return words if len(words) > 1 else []


def words_by_components(img: np.ndarray, times: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Words from connected components: noise dropped, marks over letters joined (2 px), gaps over Otsu's threshold split.

    ``times``, here and below: how often each row stands.
    """
    return words_of([banded(img) if times is None else (img, times)])[0]


def words_of(lines: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[int, int]]]:
    """``words_by_components`` of several lines, given by their bands."""
    found = components_of([(binarize(weighted_grey(rows), times), times) for rows, times in lines])
    return [_joined(parts, int(times.sum())) for parts, (_, times) in zip(found, lines)]


def _joined(parts: list[tuple[int, int, int, int, int]], h: int) -> list[tuple[int, int]]:
    spans = sorted((l, r) for l, t, r, b, n in parts if b - t >= max(2, h // 6) and n >= 4)
    merged: list[list[int]] = []
    for l, r in spans:
        if merged and l <= merged[-1][1] + 2:
            merged[-1][1] = max(merged[-1][1], r)
        else:
            merged.append([l, r])
    gaps = [b[0] - a[1] for a, b in zip(merged, merged[1:])]
    if not gaps or max(gaps) < 2 * max(1, min(gaps)):
        return []
    t = otsu_values(gaps)
    return _cut([tuple(m) for m in merged], [x > t for x in gaps])


def words_by_smearing(img: np.ndarray, times: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Words from empty columns: gaps over their mean split when wide and narrow gaps differ clearly."""
    segs = runs((mean_grey(img) < 128).sum(0) > 0)
    gaps = [b[0] - a[1] - 1 for a, b in zip(segs, segs[1:])]
    if not gaps or max(gaps) < 2 * max(1, min(gaps)):
        return []
    k = round(sum(gaps) / len(gaps))
    wide, narrow = [x for x in gaps if x > k], [x for x in gaps if x <= k]
    if not wide or not narrow or np.mean(wide) / max(np.mean(narrow), 1e-9) < 2:
        return []
    return _cut(segs, [x > k for x in gaps])


def words_by_oversplit(img: np.ndarray, times: np.ndarray | None = None, depth: int | None = None) -> list[tuple[int, int]]:
    """Words from an over-split at shallow columns, merged again unless a gap is deep and wide."""
    on = mean_grey(img) < 128
    prof = on.sum(0) if times is None else times @ on
    low = max(1, (img.shape[0] if times is None else int(times.sum())) // 10)
    segs = runs(prof > low)
    inner = [(a[1] + 1, b[0] - 1) for a, b in zip(segs, segs[1:])]
    if not inner:
        return []
    widths = [b - a + 1 for a, b in inner]
    deep = [int(prof[a : b + 1].max()) <= (low if depth is None else depth) for a, b in inner]
    t = otsu_values(widths)
    return _cut(segs, [d and w > t for d, w in zip(deep, widths)])


def windows(img: np.ndarray, width: int = 600, gap: int = 10, least_ink: float = 0.0) -> list[tuple[int, int]]:
    """Windows (first, last column) of a line, or of its ink mask, for a recognizer of limited width; nearly empty ones leave when asked to."""
    ink = img if img.dtype == bool else dark(img)
    segs = runs(ink.any(0), gap)
    out: list[list[int]] = []
    for a, b in segs:
        if out and b - out[-1][0] + 1 <= width:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if least_ink <= 0 or ink[:, a : b + 1].mean() >= least_ink]


def column_gaps(ink: np.ndarray, times: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Gaps between columns of a page: nearly empty columns, wide enough, away from the margins."""
    w = ink.shape[1]
    low = runs(ink.sum(0) <= 0.05 * ink.shape[0] if times is None else times @ ink <= 0.05 * times.sum())
    return [(a, b) for a, b in low if b - a + 1 >= max(8, w // 50) and a > 0.1 * w and b < 0.9 * w]


def usable_components(parts: list[tuple[int, int, int, int, int]], h: int, w: int) -> list[tuple[int, int, int, int, int]]:
    """Components of text size: not too large, not too long, not under the adaptive least area."""
    fit = [p for p in parts if p[4] <= min(50_000, w * h // 2) and max(p[2] - p[0], p[3] - p[1]) <= 30 * max(1, min(p[2] - p[0], p[3] - p[1]))]
    hs = sorted(p[3] - p[1] for p in fit)
    mid = hs[len(hs) // 4 : len(hs) * 3 // 4]
    least = max(4, int((sum(mid) / len(mid) * 0.25) ** 2)) if mid else 4
    return [p for p in fit if p[4] >= least]


def text_sized(parts: list[tuple[int, int, int, int, int]], h: int, w: int) -> list[tuple[int, int, int, int, int]]:
    """Components of text size as ``layout.text_components`` keeps them: half a page is not halved to whole pixels."""
    fit = [p for p in parts if p[4] <= min(50_000, w * h / 2) and max(p[2] - p[0], p[3] - p[1]) <= 30 * max(1, min(p[2] - p[0], p[3] - p[1]))]
    hs = sorted(p[3] - p[1] for p in fit)
    mid = hs[len(hs) // 4 : len(hs) * 3 // 4]
    least = max(4, int((sum(mid) / len(mid) * 0.25) ** 2)) if mid else 4
    return [p for p in fit if p[4] >= least]
