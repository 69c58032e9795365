"""Problem 8: passages of evaluation items inside documents, told from re-parameterised look-alikes.

Words are compared without case, punctuation, line and word breaks, and by the shape of their letters. In scripts written
without spaces each character, with its marks, is a word. Texts become templates: numbers, units after numbers, and words
particular to few items (names, codes) are replaced by typed placeholders; a word that at least ``constant_items`` items
(and a share ``constant_share`` of all) hold is part of the template. Windows of the items are joined with windows of the
documents by hash, on the template of the window and the values of its slots, so that a template filled with other
values does not meet its siblings. Every window is indexed: ``Params.window`` words where there is a slot, ``Params.plain``
words of template text where there is none. From each window that meets, the passage is followed to both sides word
by word: slots must agree, single misread signs, split and glued words are forgiven, and ``Params.least`` words must agree.

``p8_retold`` reports the other side of the slots: passages that keep an item's template for as many words and fill it with
other values, each of which stands for one value of the item throughout (``consistent``) or not. Every item of a template is
reported, so a passage has as many rows as there are items that it refills; without ``every`` the least stands for the items
that share a window of the template.

The constants are counted once over all items; there are at most ``1 / constant_share`` times the mean words of an item.
Items of up to ``Params.item_words`` words in all are broadcast as an index and documents are probed inside their scan, so
texts are read once and never shuffled. Beyond that bound the windows of both sides are joined by Spark and the candidates
are checked with the texts joined back; both ways give the same rows.

Null and empty texts hold nothing; items under ``least`` words cannot be found; repeated items and documents are reported
each under their own id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import written
from .canonical import IGNORABLE, representative
from .common import table
from .glyphs import LOST, near, skeleton


@dataclass(frozen=True)
class Params:
    window: int = 4  # words in a window with a slot
    plain: int = 6  # words in a window without
    least: int = 12
    constant_items: int = 4  # a word in so many items belongs to the template
    constant_share: float = 0.001  # and in such a share of them, which bounds the table of constants
    retold: int = 4  # words of the template that a re-parameterised passage holds in all
    item_words: int = 5_000_000  # words of items that may be broadcast
    cache: int = 400_000


BROKEN = re.compile(r"[-‐‑¬\xad]\s*\n\s*|[\xad¬]\s*|‐\s+")
STRIP = re.compile(rf"[^\w{LOST}!|]+")
#: Scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = "ก-໿က-႟ក-៿ぁ-ヿㇰ-ㇿ㐀-鿿豈-﫿"
PIECES = re.compile(rf"[{UNSPACED}][ัิ-ฺ็-๎ັິ-ຼ່-ໍါ-ှ឴-៓゙゚]*|[^{UNSPACED}]+")
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
#: Units of measure that stand behind a number.
UNITS = frozenset(
    """mm cm dm m km nm g kg mg t lb oz l ml cl hl s sec min h hr ms hz khz mhz ghz kb mb gb tb px dpi pt in ft mi w kw mw v a k c f pa bar cal kcal j kj n eur usd gbp rub
    мм см дм м км г кг мг т л мл с сек мин хв ч год мс гц кб мб гб пт вт квт в а руб коп грн шт std stk uhr""".split()
)
NUM, NAME, UNIT, CONST = 1, 2, 3, 4


def words(text: str) -> list[str]:
    return BROKEN.sub("", text).split()


def norm(word: str) -> str:
    """Letters and figures of a word, lower case, look-alikes folded; '' for pure punctuation."""
    w = representative(IGNORABLE.sub("", word))
    w = STRIP.sub("", w.lower()).rstrip("!|")
    return w.lstrip("|") if any(c.isalnum() for c in w) else ""


def norms(token: str) -> list[str]:
    """The words of a token: one, or one a character in scripts without spaces."""
    if HAS_UNSPACED.search(token):
        return [n for x in PIECES.findall(token) if (n := norm(x))]
    n = norm(token)
    return [n] if n else []


def plain_words(text: str) -> list[str]:
    return [n for t in words(text) for n in norms(t)]


class Template:
    """Turns texts into signs and values: a sign is a placeholder or a word of the template, a value the shape of the word."""

    def __init__(self, constants: frozenset[str], p: Params = Params()):
        self.p, self.constants = p, constants
        self.ids: dict[str, int] = {}
        self.plain: list[str] = []
        self.sign, self.value, self.unit = np.zeros(1024, np.int64), np.zeros(1024, np.uint64), np.zeros(1024, bool)
        self.tokens: dict[str, tuple[int, ...]] = {}

    def _id(self, n: str) -> int:
        i = self.ids.get(n)
        if i is None:
            i = self.ids[n] = len(self.plain)
            self.plain.append(n)
            if i >= len(self.sign):
                self.sign, self.value, self.unit = (np.concatenate([a, np.zeros_like(a)]) for a in (self.sign, self.value, self.unit))
            s = skeleton(n)
            v = xxhash.xxh3_64_intdigest(s)
            self.value[i] = v
            self.sign[i] = CONST + (v >> 3) if s in self.constants else NUM if any(c.isdigit() for c in n) else NAME
            self.unit[i] = n in UNITS
        return i

    def _token(self, t: str) -> tuple[int, ...]:
        ids = tuple(self._id(n) for n in norms(t))
        if len(t) <= 64:
            self.tokens[t] = ids
        return ids

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts in a row, and the bounds of the texts."""
        if len(self.tokens) > self.p.cache or len(self.plain) > self.p.cache:
            self.tokens.clear()
            self.ids.clear()
            self.plain.clear()
        get, add = self.tokens.get, self._token
        ids: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                for t in words(text):
                    x = get(t)
                    ids += add(t) if x is None else x
            ends[k + 1] = len(ids)
        return np.array(ids, np.int64), ends

    def signs(self, ids: np.ndarray) -> np.ndarray:
        s = self.sign[ids]
        after = np.flatnonzero(self.unit[ids][1:] & (s[:-1] == NUM)) + 1
        s[after] = UNIT
        return s

    def windows(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template hash, slot hash, start) of every window inside one text."""
        p, signs = self.p, self.signs(ids)
        slot = signs < CONST
        upto = np.concatenate([[0], np.cumsum(slot)])
        owner_end = np.repeat(ends[1:], np.diff(ends))
        out = []
        for n, filled in ((p.window, True), (p.plain, False)):
            m = max(0, len(ids) - n + 1)
            at = np.arange(m)
            slots = upto[n:][:m] - upto[:m]
            at = at[(at + n <= owner_end[:m]) & ((slots > 0) if filled else (slots == 0))]
            tpl, val = np.full(len(at), n, np.uint64), np.zeros(len(at), np.uint64)
            for k in range(n):
                tpl = tpl * np.uint64(0x9E3779B97F4A7C15) + signs[at + k].view(np.uint64) + np.uint64(1)
                if filled:
                    val = val * np.uint64(0xD6E8FEB86659FD93) + np.where(slot[at + k], self.value[ids[at + k]], np.uint64(1))
            out.append((tpl, val, at))
        return tuple(np.concatenate(x) for x in zip(*out))


    def shapes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template hash, 0, start) of every window of ``least`` words inside one text that holds a slot and a word of a template.

        Every passage of ``least`` words with both has such a window, where one stands beside the other.
        """
        n, signs = self.p.least, self.signs(ids)
        upto = np.concatenate([[0], np.cumsum(signs < CONST)])
        m = max(0, len(ids) - n + 1)
        at = np.arange(m)
        slots = upto[n:][:m] - upto[:m]
        at = at[(at + n <= np.repeat(ends[1:], np.diff(ends))[:m]) & (slots > 0) & (slots < n)]
        tpl = np.full(len(at), n, np.uint64)
        for k in range(n):
            tpl = tpl * np.uint64(0x9E3779B97F4A7C15) + signs[at + k].view(np.uint64) + np.uint64(1)
        return tpl, np.zeros(len(at), np.uint64), at


def _mixed(tpl: np.ndarray, val: np.ndarray) -> np.ndarray:
    return (tpl ^ (tpl >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + val


def follow(doc: list[str], item: list[str], i: int, j: int) -> tuple[int, int, int, int]:
    """(words of the item, first word of the document, one behind the last, first word of the item) of the agreeing passage around doc[i], item[j]."""

    def walk(i: int, j: int, step: int) -> tuple[int, int]:
        while 0 <= i < len(doc) and 0 <= j < len(item):
            if near(doc[i], item[j]):
                i, j = i + step, j + step
            elif 0 <= i + step < len(doc) and len(item[j]) > len(doc[i]) and near(doc[i] + doc[i + 1] if step > 0 else doc[i - 1] + doc[i], item[j]):
                i, j = i + 2 * step, j + step
            elif 0 <= j + step < len(item) and len(doc[i]) > len(item[j]) and near(item[j] + item[j + 1] if step > 0 else item[j - 1] + item[j], doc[i]):
                i, j = i + step, j + 2 * step
            else:
                break
        return i, j

    i1, j1 = walk(i, j, 1)
    i0, j0 = walk(i - 1, j - 1, -1)
    return j1 - j0 - 1, i0 + 1, i1, j0 + 1


class Scanner:
    """Probe side: finds the items of an index in texts."""

    windows_of = Template.windows

    def __init__(self, template: Template, items: list[tuple[int, str]]):
        self.tpl = template
        self.ids = [i for i, _ in items]
        self.words = [plain_words(t) for _, t in items]
        ids, ends = template.read([t for _, t in items])
        tpl, val, at = type(self).windows_of(template, ids, ends)
        key = _mixed(tpl, val)
        order = np.argsort(key, kind="stable")
        self.keys, self.at = key[order], at[order]
        self.item = np.searchsorted(ends, self.at, side="right") - 1
        self.pos = self.at - ends[self.item]

    def leaked(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(number of the text, item id, words of the longest passage)."""
        ids, ends = self.tpl.read(texts)
        if not len(self.keys) or not len(ids):
            return []
        tpl, val, at = self.tpl.windows(ids, ends)
        key = _mixed(tpl, val)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        hit = np.flatnonzero(hi > lo)
        hit = hit[np.argsort(at[hit], kind="stable")]
        best: dict[tuple[int, int], int] = {}
        done: dict[tuple[int, int, int], int] = {}
        held: dict[int, list[str]] = {}
        plain = self.tpl.plain
        for h in hit.tolist():
            d = int(np.searchsorted(ends, at[h], side="right")) - 1
            i = int(at[h] - ends[d])
            for k in range(lo[h], hi[h]):
                e, j = int(self.item[k]), int(self.pos[k])
                if done.get((d, e, i - j), -1) > i:  # inside a passage already followed
                    continue
                if d not in held:
                    held = {d: [plain[x] for x in ids[ends[d] : ends[d + 1]].tolist()]}
                n, _, last, _ = follow(held[d], self.words[e], i, j)
                done[d, e, i - j] = last
                if n >= self.tpl.p.least and n > best.get((d, self.ids[e]), 0):
                    best[d, self.ids[e]] = n
        return [(d, e, n) for (d, e), n in best.items()]


class Retold(Scanner):
    """Probe side for templates filled with other values."""

    windows_of = Template.shapes

    def __init__(self, template: Template, items: list[tuple[int, str]], every: bool = True):
        super().__init__(template, sorted(items))
        if not every:  # the least item stands for those that share a window
            self.keys, first = np.unique(self.keys, return_index=True)
            self.at, self.item, self.pos = self.at[first], self.item[first], self.pos[first]
        shared: dict[tuple[int, ...], int] = {}
        self.signs_of, self.like = [], []  # items of the same signs are followed once
        for ws in self.words:
            ids = np.array([template._id(w) for w in ws], np.int64)
            signs = template.signs(ids).tolist() if len(ids) else []
            self.signs_of.append(signs)
            self.like.append(shared.setdefault(tuple(signs), len(shared)))

    def retold(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, bool]]:
        """(number of the text, item id, words, slots kept, slots replaced, consistent) of the longest passage of each item."""
        ids, ends = self.tpl.read(texts)
        if not len(self.keys) or not len(ids):
            return []
        tpl, val, at = self.tpl.shapes(ids, ends)
        key = _mixed(tpl, val)
        first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        hit = np.flatnonzero(last > first)
        signs, plain = self.tpl.signs(ids).tolist(), self.tpl.plain
        best: dict[tuple[int, int], tuple] = {}
        done: dict[tuple[int, int], int] = {}
        span: dict[tuple[int, int], tuple[int, int]] = {}
        for h in hit[np.argsort(at[hit], kind="stable")].tolist():
            i = int(at[h])
            d = int(np.searchsorted(ends, i, side="right")) - 1
            for k in range(first[h], last[h]):
                e, j = int(self.item[k]), int(self.pos[k])
                if done.get((e, i - j), -1) > i:
                    continue
                theirs, mine = self.signs_of[e], self.words[e]
                start, end = span.get((self.like[e], i - j), (0, 0))
                if not start <= i < end:
                    start, end = i, i
                    while start > ends[d] and start - i + j > 0 and signs[start - 1] == theirs[start - i + j - 1]:
                        start -= 1
                    while end < ends[d + 1] and end - i + j < len(theirs) and signs[end] == theirs[end - i + j]:
                        end += 1
                    span[self.like[e], i - j] = start, end
                done[e, i - j] = end
                pairs = [(mine[x - i + j], plain[ids[x]]) for x in range(start, end) if theirs[x - i + j] < CONST]
                if end - start < self.tpl.p.least or end - start - len(pairs) < self.tpl.p.retold:
                    continue
                same = [near(a, b) for a, b in pairs]
                other = {x for x, s in zip(pairs, same) if not s}
                row = (end - start, sum(same), len(pairs) - sum(same), len({a for a, _ in other}) == len(other) == len({b for _, b in other}))
                if other and row > best.get((d, self.ids[e]), (0,)):
                    best[d, self.ids[e]] = row
        return [(d, e, *row) for (d, e), row in best.items()]


LEAK = "doc_id bigint, item_id bigint, run int"


def _leaks(docs: list[int], items: list[int], runs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(runs, pa.int32())], names=["doc_id", "item_id", "run"])


def constants(items: DataFrame, p: Params = Params()) -> tuple[frozenset[str], int]:
    """Shapes of the words that belong to templates, counted over all items, and the number of words. ``items``: item_id, item_text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, shapes, sizes = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = plain_words(t)
                part = {skeleton(w) for w in ws if not any(c.isdigit() for c in w)}
                ids += [i] * (len(part) + 1)
                shapes += [None, *part]
                sizes += [len(ws)] + [0] * len(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shapes, pa.string()), pa.array(sizes, pa.int64())], names=["item_id", "shape", "words"])

    held = items.mapInArrow(count, "item_id bigint, shape string, words bigint")
    held = written(held.groupBy("shape").agg(F.count_distinct("item_id").alias("n"), F.sum("words").alias("words")), "item-words")
    whole = held.where("shape is null").first()
    if whole is None:
        return frozenset(), 0
    limit = max(min(p.constant_items, whole.n), p.constant_share * whole.n)
    return frozenset(r.shape for r in held.where(F.col("shape").isNotNull() & (F.col("n") >= limit)).select("shape").collect()), int(whole.words)


def leaks(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, run): documents holding ``run >= p.least`` consecutive words of an item. ``docs``: doc_id, text; ``items``: item_id, item_text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").where("item_id is not null and length(item_text) > 0").distinct()
    const, n_words = constants(items, p)
    found = _probed(docs, items, const, p) if n_words <= p.item_words else _joined(docs, items, const, p)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def _probed(docs: DataFrame, items: DataFrame, const: frozenset[str], p: Params) -> DataFrame:
    """Items broadcast, documents probed in their scan."""
    shared = docs.sparkSession.sparkContext.broadcast((const, sorted((r.item_id, r.item_text) for r in items.collect())))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Template(shared.value[0], p), shared.value[1])
        for b in batches:
            got = scanner.leaked(b.column(1).to_pylist())
            yield _leaks(b.column(0).take(pa.array([d for d, _, _ in got], pa.int64())).to_pylist(), [e for _, e, _ in got], [n for _, _, n in got])

    return docs.mapInArrow(scan, LEAK)


def _joined(docs: DataFrame, items: DataFrame, const: frozenset[str], p: Params) -> DataFrame:
    """The same by joins: windows of both sides meet, then the texts of the pairs that met."""
    shared = docs.sparkSession.sparkContext.broadcast(const)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, item, item_text in zip(*(c.to_pylist() for c in b.columns)):
                out += [(doc, e, n) for _, e, n in Scanner(Template(shared.value, p), [(item, item_text)]).leaked([text])]
            yield _leaks(*([x[k] for x in out] for k in range(3)))

    return _met(docs, items, shared, p, Template.windows).mapInArrow(check, LEAK)


def _met(docs: DataFrame, items: DataFrame, shared: Broadcast, p: Params, windows: Callable) -> DataFrame:
    """(doc_id, text, item_id, item_text) of the pairs of which a window meets."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(shared.value, p)
        for b in batches:
            ids, ends = template.read(b.column(1).to_pylist())
            tpl, val, at = windows(template, ids, ends)
            row = np.searchsorted(ends, at, side="right") - 1
            key = pa.array(_mixed(tpl, val).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), key, pa.array((at - ends[row]).astype(np.int32))], names=["id", "key", "pos"])

    d = docs.mapInArrow(split, "id bigint, key bigint, pos int").withColumnRenamed("id", "doc_id")
    # items of one id may have several texts: the text stands for the item
    i = items.select(F.xxhash64("item_text").alias("id"), "item_text").mapInArrow(split, "id bigint, key bigint, pos int").select(F.col("id").alias("text_id"), "key", F.col("pos").alias("at")).distinct()
    met = written(d.join(i, "key").select("doc_id", "text_id").distinct(), "leak-candidates")
    texts = items.select(F.xxhash64("item_text").alias("text_id"), "item_id", "item_text")
    return met.join(docs, "doc_id").join(texts, "text_id").select("doc_id", "text", "item_id", "item_text")


RETOLD = "doc_id bigint, item_id bigint, words int, kept int, replaced int, consistent boolean"


def retold(docs: DataFrame, items: DataFrame, p: Params = Params(), every: bool = False) -> DataFrame:
    """Documents with a passage of ``p.least`` words or more, ``p.retold`` of them of the template, that fills the template of an item with other values.

    ``every`` item of the template, or only the least. Items of up to ``p.item_words`` words are broadcast; beyond, the windows
    of every item are joined.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").where("item_id is not null and length(item_text) > 0").distinct()
    const, n_words = constants(items, p)

    def rows(ids: pa.Array, got: list[tuple]) -> pa.RecordBatch:
        cols = [ids, *(pa.array([g[k] for g in got], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.bool_())))]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in RETOLD.split(", ")])

    if n_words > p.item_words and not every:
        raise ValueError("more words of items than item_words; ask for every item or raise the bound")
    if n_words > p.item_words:
        constant = docs.sparkSession.sparkContext.broadcast(const)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(doc, *g[1:]) for doc, text, item, item_text in zip(*(c.to_pylist() for c in b.columns)) for g in Retold(Template(constant.value, p), [(item, item_text)]).retold([text])]
                yield rows(pa.array([g[0] for g in got], pa.int64()), got)

        found = _met(docs, items, constant, p, Template.shapes).mapInArrow(check, RETOLD)
    else:
        shared = docs.sparkSession.sparkContext.broadcast((const, sorted((r.item_id, r.item_text) for r in items.collect())))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Retold(Template(shared.value[0], p), shared.value[1], every)
            for b in batches:
                got = scanner.retold(b.column(1).to_pylist())
                yield rows(b.column(0).take(pa.array([g[0] for g in got], pa.int64())), got)

        found = docs.mapInArrow(scan, RETOLD)
    # repeated documents and items with several texts: the longest passage
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "kept", "replaced", "consistent")).alias("r")).select("doc_id", "item_id", "r.*")


def p8_retold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-parameterised items in documents: every item whose template a document refills."""
    return retold(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "item_text"), every=True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "item_text"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and longest run per leaked item."""
    return p8_leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("run").alias("longest_run"))
