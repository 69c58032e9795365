"""Problem 5: noise in text from scanned pages: broken words, misread signs, running headers, page numbers.

* Words are counted over all lines and grouped by the skeleton of their confusable glyphs. A rare form is a misreading
  of a frequent form of its group when the table of confusions turns one into the other; where several frequent forms
  are possible, the one seen more often after the same previous word is taken. A word with a lost sign is matched with the
  frequent words of its length that share the half without it, and is noise even where none fits.
* Lines ending in a hyphen are joined with the first word of the next line of the block, or of the block that continues
  it in reading order, past page furniture, figures and tables, on the same page or the next one. The word is broken by
  the typesetting unless the corpus knows the hyphenated spelling better than the joined one.
* Page numbers are lines that are nothing else, wherever they stand, unless they end the sentence of the line before.
  Running headers are lines, of any length and place, whose digit-masked, shape-folded text stands as page furniture
  in several extractions or recurs on several pages of one, and that do not go on a sentence.
* ``paragraphs`` applies all of it: furniture leaves, misreadings are replaced, broken words are joined, and lines flow
  together by SQL windows, within their block and on into the block that continues its last word.

One pass over the lines writes what all of them need to know of a line (first word, broken last word, shape of a possible
header, page number); the lines of a block meet once. Counts of words, pairs and shapes are sums with map-side
combination. Tables of words are broadcast within ``Params.broadcast_words`` and joined beyond it, with the same result.
Exact duplicate rows count once. Null and empty lines have no noise; a null label or block counts as unknown, and blocks
of unknown extraction continue no other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import written
from .common import table
from .glyphs import LOST, misreads, skeleton


@dataclass(frozen=True)
class Params:
    ratio: int = 8  # a form must be so many times rarer than the frequent form of its group
    frequent: int = 6  # least count of a frequent form
    least_letters: int = 3
    cache: int = 300_000
    broadcast_words: int = 1_500_000  # words, misread or doubtful, that may be broadcast
    short: int = 4  # words so short, and words with several frequent forms, must be supported by their neighbours
    context: float = 0.5


EDGE = " \t\r\n.,;:()[]{}«»„“”\"'‘’…?/<>*•–—·|=+"
WORD_CORE = re.compile(r"[^\W\d_]")
HYPHENS = "-‐‑­¬"
#: Nothing but a page number, bare, in signs, or with the word for page or sheet.
PAGENO = (
    r"(?iu)^\s*(?:[-–—\[(|.·]*\s*(?:\d{1,4}|[ivxlcdm]{1,12})\s*[-–—\])|.·]*"
    r"|(?:page|p|pp|pg|seite|s|página|pagina|pág|pag|страница|стр|с|сторінка|стор|лист|аркуш|арк|feuille|folio|fol|hoja|blatt|sheet|blatt)\.?\s*\d{1,4}"
    r"(?:\s*(?:of|von|de|sur|из|з|/)\s*\d{1,4})?|\d{1,4}\s*(?:/|of|von|de|sur|из|з)\s*\d{1,4})\s*$"
)


def word_of(token: str) -> str:
    """A token as it is counted: lower case, without punctuation around it."""
    t = token.strip(EDGE)
    if t.endswith("!"):
        t = t.rstrip("!")
    return t.lower() if WORD_CORE.search(t) else ""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_lines").where("line_id is not null and length(text) > 0")


# ---------------------------------------------------------------------------------------------------------------------
# Misread signs


def word_counts(lines: DataFrame, p: Params) -> DataFrame:
    """(word, n): counts of all words over all lines."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for t, n in tokens.items():
                w = word_of(t)
                if w:
                    words[w] += n
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                tokens.update(t.split())
            if len(tokens) > p.cache:
                yield flush()
        yield flush()

    return lines.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _frame(words: DataFrame) -> DataFrame:
    """Add the skeleton of each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([skeleton(w) for w in b.column(0).to_pylist()], pa.string())], names=["word", "n", "skel"])

    return words.mapInArrow(run, "word string, n bigint, skel string")


def misreadings(words: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n, right, support): misread forms with the frequent forms they may stand for, null where none fits a lost sign. ``words``: word, n."""
    w = _frame(words.where(F.length("word") >= p.least_letters))
    strong = w.where((F.col("n") >= p.frequent) & ~F.col("word").contains(LOST)).select("skel", F.col("word").alias("right"), F.col("n").alias("support"))
    pairs = w.join(strong, "skel").where("word <> right and support >= n * %d" % p.ratio).select("word", "n", "right", "support")
    # a sign lost: known by the mark itself; the half of the word without it finds the words it may be
    lost = words.where(F.col("word").rlike(rf"\p{{L}}{LOST}|{LOST}\p{{L}}") & (F.length("word") >= p.least_letters))
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    left, right = F.substring("word", F.lit(1), half), F.substring("word", half + 1, size)
    ends = F.array(F.struct(F.lit("l").alias("side"), left.alias("part")), F.struct(F.lit("r").alias("side"), right.alias("part")))
    whole = words.where((F.col("n") >= p.frequent) & ~F.col("word").contains(LOST)).select(size.alias("size"), F.explode(ends).alias("e"), F.col("word").alias("right"), F.col("n").alias("support"))
    seek = lost.select("word", "n", size.alias("size"), F.explode(ends).alias("e")).where(~F.col("e.part").contains(LOST) & (F.length("e.part") > 0))
    found = seek.join(whole, ["size", "e"]).select("word", "n", "right", "support")

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [misreads(r, x) > 0 for x, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    out = pairs.unionByName(found).mapInArrow(derive, "word string, n bigint, right string, support bigint").distinct()
    return out.unionByName(lost.select("word", "n", F.lit(None).cast("string").alias("right"), F.lit(0).cast("bigint").alias("support")))


def in_context(lines: DataFrame, bad: DataFrame, p: Params) -> DataFrame:
    """Misreadings that their neighbours support: (word, right), one form a word; right is null for a lost sign that nothing fits.

    Long words with one possible form stand as they are. For the others the pairs (previous word, word) and (word, next
    word) are counted over all lines, for the doubtful words and their possible forms only; a form is supported by the
    share of the word's pairs that it occurs in as well.
    """
    fits = bad.where("right is not null")
    several = fits.groupBy("word").agg(F.count(F.lit(1)).alias("forms"))
    marked = fits.join(several, "word").withColumn("doubt", (F.length("word") <= p.short) & ~F.col("word").rlike(r"\p{L}[\d!|]+\p{L}") | (F.col("forms") > 1))
    marked = written(marked, "doubts")
    sure = marked.where("not doubt").select("word", "right")
    lost = bad.where("right is null").select("word", F.lit(None).cast("string").alias("right")).distinct()
    doubt = marked.where("doubt")
    n = doubt.count()
    if n == 0:
        good = sure.limit(0)
    else:
        good = _supported(lines, doubt, n, p)
    # one row a word; a lost sign is noise whether or not a form is known
    return sure.unionByName(good).unionByName(lost).groupBy("word").agg(F.max("right").alias("right"))


def _supported(lines: DataFrame, doubt: DataFrame, n: int, p: Params) -> DataFrame:
    words = doubt.select(F.explode(F.array("word", "right")).alias("word")).distinct()
    held = n <= p.broadcast_words
    wanted = lines.sparkSession.sparkContext.broadcast(frozenset(r.word for r in words.collect()) if held else None)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, known, out = wanted.value, {}, Counter()

        def flush() -> pa.RecordBatch:
            items = list(out.items())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["word", "near", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                before = ""
                open_ = ""
                for x in t.split():
                    w = known.get(x)
                    if w is None:
                        if len(known) > p.cache:
                            known.clear()
                        w = known[x] = word_of(x)
                    if open_:
                        out[open_, ">" + w] += 1
                        open_ = ""
                    if want is None and w or want is not None and w in want:
                        if before:
                            out[w, "<" + before] += 1
                        open_ = w
                    before = w
            if len(out) > p.cache:
                yield flush()
        yield flush()

    seen = lines.select("text").mapInArrow(pairs, "word string, near string, n bigint")
    seen = written((seen if held else seen.join(words, "word", "left_semi")).groupBy("word", "near").agg(F.sum("n").alias("n")), "pairs")
    own = seen.join(doubt.select("word", "right"), "word")
    model = seen.where("n >= 2").select(F.col("word").alias("right"), "near", F.lit(1).alias("held"))
    share = own.join(model, ["right", "near"], "left").groupBy("word", "right").agg((F.sum(F.col("n") * F.coalesce("held", F.lit(0))) / F.sum("n")).alias("share"))
    return share.where(F.col("share") >= p.context).groupBy("word").agg(F.max_by("right", F.struct("share", "right")).alias("right"))


def glyph_lines(lines: DataFrame, bad: DataFrame, n_bad: int, p: Params) -> DataFrame:
    """Lines with at least one word of ``bad`` (word) that are not junk altogether."""
    src = lines.select("line_id", "text")
    if n_bad <= p.broadcast_words:
        shared = lines.sparkSession.sparkContext.broadcast(frozenset(r.word for r in bad.select("word").distinct().collect()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wrong = shared.value
            seen: dict[str, bool] = {}
            for b in batches:
                hits = []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for x in t.split():
                        f = seen.get(x)
                        if f is None:
                            if len(seen) > p.cache:
                                seen.clear()
                            f = seen[x] = word_of(x) in wrong
                        if f:
                            if not junk(t):
                                hits.append(i)
                            break
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hits, pa.int64()))], names=["line_id"])

        return src.mapInArrow(scan, "line_id bigint")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ws = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not junk(t):
                    for w in {word_of(x) for x in t.split()} - {""}:
                        ids.append(i)
                        ws.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.string())], names=["line_id", "word"])

    return src.mapInArrow(explode, "line_id bigint, word string").join(bad.select("word").distinct(), "word", "left_semi").select("line_id").distinct()


def junk(text: str) -> bool:
    """A line that mostly consists of signs and scraps."""
    parts = text.split()
    whole = sum(1 for t in parts if sum(c.isalpha() for c in t) >= max(3, 0.6 * len(t)))
    return len(parts) >= 4 and whole < 0.25 * len(parts)


# ---------------------------------------------------------------------------------------------------------------------
# Lines and their places

LEFT = re.compile(rf"((?:[^\W_]|[{HYPHENS}\u0300-\u036f’'{LOST}!])*[^\W\d_][\u0300-\u036f]*)([{HYPHENS}])\s*$")
FIRST = re.compile(rf"\s*((?:[^\W_]|[{LOST}!])(?:[^\W_]|[\u0300-\u036f’'{LOST}!-])*)")
NO_HEADER = re.compile(r"[.!?;:,]\s*$|\.{4}|//|^\s*\[\d+\]|\t| {4,}\S.* {4,}\S|</?t[dr]")
ENDED = re.compile(r"[.!?…。！？।؟:;][»”\"’')\]]*\s*$")
PAGE = re.compile(PAGENO)
_MASKS = [(re.compile(r"\d+"), "#"), (re.compile(r"(?<=[\s|—–-])[ivxlc]{1,6}$|^[ivxlc]{1,6}(?=[\s|])|(?<=[—–-]\s)[a-z]#?(?=$|\s)"), "#"), (re.compile(r"[#\s|—–\[\]().-]+$|^[#\s|—–\[\]().-]+"), ""), (re.compile(r"\s+"), " ")]


def masked(text: str) -> str:
    """Text of a possible header: digits and roman numbers masked, letters folded to lower case, signs at the ends dropped."""
    t = text.lower()
    for pattern, to in _MASKS:
        t = pattern.sub(to, t)
    return t


FACTS = "line_id bigint, block_id bigint, extraction_id bigint, page_no int, line_no int, tall boolean, left string, mark string, first string, low boolean, pageno boolean, dashed boolean, ended boolean, shape bigint"


def facts(lines: DataFrame) -> DataFrame:
    """What has to be known of each line. ``shape``: hash of the skeleton of the mask, so that a misread header equals its model; null where a line can be no header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FACTS.split(", ")]
        for b in batches:
            left, mark, first, low, page, dashed, ended, shape = [], [], [], [], [], [], [], []
            for t in b.column(6).to_pylist():
                m = LEFT.search(t) if t.rstrip()[-1:] in HYPHENS else None
                left.append(m.group(1).lower() if m else None)
                mark.append(m.group(2) if m else None)
                f = FIRST.match(t)
                first.append(f.group(1).lower() if f else None)
                low.append(t.lstrip()[:1].islower())
                page.append(PAGE.match(t) is not None)
                dashed.append(t.lstrip()[:1] in "-–—" and t.rstrip()[-1:] in "-–—")
                ended.append(ENDED.search(t) is not None)
                k = None
                if not page[-1] and not low[-1] and not NO_HEADER.search(t) and sum(map(str.isalpha, t)) >= 3:
                    k = masked(t)
                shape.append(xxhash.xxh3_64_intdigest(skeleton(k)) - (1 << 63) if k is not None and len(k) >= 4 else None)
            tall = [(h or 0.0) >= 16 for h in b.column(5).to_pylist()]
            cols = [*b.columns[:5], pa.array(tall, pa.bool_()), pa.array(left, pa.string()), pa.array(mark, pa.string()), pa.array(first, pa.string()), pa.array(low, pa.bool_()), pa.array(page, pa.bool_()), pa.array(dashed, pa.bool_()), pa.array(ended, pa.bool_()), pa.array(shape, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ids = [F.col(c).cast(t).alias(c) for c, t in (("line_id", "bigint"), ("block_id", "bigint"), ("extraction_id", "bigint"), ("page_no", "int"), ("line_no", "int"))]
    return lines.select(*ids, F.col("box.h").cast("double").alias("height"), "text").mapInArrow(read, FACTS)


def placed(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Facts with the label of the block, rank in it, first word of the next line and whether the line before ended a sentence.

    The lines of a block meet in one exchange; duplicates leave behind it.
    """
    label = blocks.groupBy("block_id").agg(F.max("label").alias("label"))
    by = Window.partitionBy("block_id").orderBy("line_no", "line_id")
    inside = facts(lines.where("block_id is not null")).repartition("block_id").dropDuplicates(["block_id", "line_id"]).join(label, "block_id", "left")
    inside = inside.withColumns({"rank": F.row_number().over(by), "next_first": F.lead("first").over(by), "last": F.lead("line_id").over(by).isNull(), "fresh": F.coalesce(F.lag("ended").over(by), F.lit(True))})
    alone = facts(lines.where("block_id is null")).withColumns({"label": F.lit(None).cast("string"), "rank": F.lit(1), "next_first": F.lit(None).cast("string"), "last": F.lit(True), "fresh": F.lit(True)})
    # behind other lines of a block a number with a full stop is the end of their sentence
    cols = ["line_id", "block_id", "extraction_id", "page_no", "label", "rank", "tall", "left", "mark", "next_first", "last", "fresh", "first", "low", F.expr("pageno and (dashed or fresh and (rank = 1 or not ended))").alias("pageno"), F.when(F.col("fresh"), F.col("shape")).alias("shape")]
    both = inside.select(*cols).unionByName(alone.select(*cols))
    return both.where("shape is not null or left is not null or pageno or rank <= 2")


# ---------------------------------------------------------------------------------------------------------------------
# Broken words


def broken_words(at: DataFrame, blocks: DataFrame, furniture: DataFrame, counts: DataFrame) -> DataFrame:
    """(line_id, next_id): lines whose last word is broken by the typesetting; next_id is the block that continues it, null
    for the line's own.

    ``at``: as of ``placed``; ``blocks``: block_id, extraction_id, page_no, block_idx, skip (no running text);
    ``furniture``: line_id of headers and page numbers, which the continuation jumps over.
    """
    ends = at.where("left is not null").select("line_id", "block_id", "left", "mark", "next_first", "last")
    here = ends.where("next_first is not null").select("line_id", "left", "mark", F.col("next_first").alias("right"), F.lit(None).cast("bigint").alias("next_id"))
    # last line of its block: the next block in reading order that goes on with a small letter
    top = at.where("rank <= 2 and block_id is not null").select("line_id", "block_id", "rank", "first", "low").join(furniture, "line_id", "left_anti")
    top = top.groupBy("block_id").agg(F.min_by(F.struct("first", "low"), "rank").alias("f"))
    cut = ends.where("last and next_first is null and block_id is not null").groupBy("block_id").agg(F.min("line_id").alias("cut_line"))
    b = blocks.where("extraction_id is not null and page_no is not null").join(top, "block_id").join(cut, "block_id", "left")
    b = b.withColumn("start", F.when(~F.col("skip") & F.col("f.low") & F.col("f.first").isNotNull(), F.struct(F.col("f.first").alias("right"), F.col("block_id").alias("next_id"), F.col("page_no").alias("page"))))
    page = Window.partitionBy("extraction_id", "page_no").orderBy("block_idx", "block_id")
    b = written(b.select("extraction_id", "page_no", "block_idx", "block_id", "cut_line", "start", F.first("start", True).over(page.rowsBetween(1, Window.unboundedFollowing)).alias("next")), "block-starts")
    tops = b.where("start is not null").groupBy("extraction_id", "page_no").agg(F.min_by("start", F.struct("block_idx", "block_id")).alias("over")).withColumn("page_no", F.col("page_no") - 1)
    across = b.where("cut_line is not null").join(tops, ["extraction_id", "page_no"], "left").withColumn("r", F.coalesce("next", "over")).where("r is not null")
    across = across.select(F.col("cut_line").alias("line_id"), F.col("r.right").alias("right"), F.col("r.next_id").alias("next_id")).join(ends.select("line_id", "left", "mark"), "line_id")
    pairs = here.unionByName(across.select("line_id", "left", "mark", "right", "next_id"))
    spellings = F.array(F.struct(F.concat("left", "right").alias("word"), F.lit(True).alias("joined")), F.struct(F.concat("left", F.lit("-"), "right").alias("word"), F.lit(False).alias("joined")))
    seen = pairs.select("line_id", "next_id", "mark", F.explode(spellings).alias("s")).select("line_id", "next_id", "mark", "s.word", "s.joined").join(counts.select("word", "n"), "word", "left")
    seen = seen.groupBy("line_id", "next_id", "mark").agg(F.max(F.when(F.col("joined"), F.col("n"))).alias("n_joined"), F.max(F.when(~F.col("joined"), F.col("n"))).alias("n_hyphened"))
    better = F.coalesce("n_hyphened", F.lit(0)) > F.coalesce("n_joined", F.lit(0))
    return seen.where(F.col("mark").isin("­", "¬") | ~better).select("line_id", "next_id")


# ---------------------------------------------------------------------------------------------------------------------
# Furniture


def headers(at: DataFrame) -> DataFrame:
    """(line_id): running headers and footers. ``at``: as of ``placed``."""
    label = F.coalesce(F.col("label"), F.lit(""))
    s = at.where("shape is not null").select("line_id", "extraction_id", "page_no", "shape", label.rlike("^page (?:header|footer)$").alias("furniture"), (label.isin("title", "section header", "caption", "list", "table", "formula", "figure") | F.col("tall")).alias("title"))
    here = s.groupBy("extraction_id", "shape").agg(F.min("page_no").alias("from"), F.max("page_no").alias("upto"), F.sum(F.col("furniture").cast("int")).alias("marked"))
    here = written(here, "shapes")
    # a header is a shape that stands as labelled page furniture in some extractions, or recurs over an extraction's pages
    known = here.where("marked > 0").groupBy("shape").agg(F.sum("marked").alias("as_furniture"), F.count(F.lit(1)).alias("in_docs"))
    # null-safe: lines without an extraction are judged by the corpus alone
    models = here.join(known, "shape").where("in_docs >= 2 or (from < upto and (marked > 0 or as_furniture >= 2))").select(F.col("extraction_id").alias("e"), F.col("shape").alias("sh"))
    like = s.where("not furniture and not title").join(models, F.col("shape").eqNullSafe(F.col("sh")) & F.col("extraction_id").eqNullSafe(F.col("e")), "left_semi")
    return s.where("furniture").select("line_id").unionByName(like.select("line_id")).distinct()


def noise(spark: SparkSession, sf_dir: str, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(line_id, kind, next_id) for all four kinds, next_id as of ``broken_words``, and the misreadings (word, right)."""
    lines = lines_of(spark, sf_dir)
    counts = written(word_counts(lines, p), "word-counts")
    bad = written(in_context(lines, written(misreadings(counts, p), "candidates"), p), "misreadings")
    glyph = glyph_lines(lines, bad, bad.count(), p)
    label = F.lower(F.trim("label"))
    skip = F.coalesce(label.rlike("^(?:page header|page footer|figure|table|caption|formula|footnote|title|section header)$"), F.lit(False))
    blocks = table(spark, sf_dir, "blocks").where("block_id is not null").select(F.col("block_id").cast("bigint").alias("block_id"), "extraction_id", "page_no", "block_idx", label.alias("label"), skip.alias("skip"))
    at = written(placed(lines, blocks), "line-facts")
    header = written(headers(at), "headers")
    pageno = at.where("pageno").select("line_id").distinct()
    places = blocks.groupBy("block_id").agg(F.max("extraction_id").alias("extraction_id"), F.max("page_no").alias("page_no"), F.max("block_idx").alias("block_idx"), F.max("skip").alias("skip"))
    hyphen = broken_words(at, places, header.unionByName(pageno), counts)
    out = None
    for df, kind in ((hyphen, "hyphen"), (glyph, "glyph"), (header, "header"), (pageno, "pageno")):
        part = df.select("line_id", F.lit(kind).alias("kind"), F.col("next_id") if kind == "hyphen" else F.lit(None).cast("bigint").alias("next_id"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("line_id", "kind").agg(F.min("next_id").alias("next_id")), bad


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(spark, sf_dir)[0].select("line_id", "kind")


def repaired(token: str, right: str) -> str:
    """A token with its word replaced, in the case it stands in."""
    w = word_of(token)
    if token.strip(EDGE)[:1].isupper():
        right = right.upper() if token.isupper() else right[0].upper() + right[1:]
    i = token.lower().find(w)
    return token[:i] + right + token[i + len(w) :] if i >= 0 else token


def corrected(lines: DataFrame, bad: DataFrame, p: Params) -> DataFrame:
    """Replace misread words in ``text``. ``lines``: line_id (unique), text, and more; ``bad``: word, right."""
    known = bad.where("right is not null").select("word", "right")
    at = lines.columns.index("text")
    if known.count() <= p.broadcast_words:
        shared = lines.sparkSession.sparkContext.broadcast({r.word: r.right for r in known.collect()})

        def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right = shared.value

            def word(m: re.Match) -> str:
                r = right.get(word_of(m.group()))
                return m.group() if r is None else repaired(m.group(), r)

            for b in batches:
                cols = list(b.columns)
                cols[at] = pa.array([re.sub(r"\S+", word, t) for t in b.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        return lines.mapInArrow(fix, lines.schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, x, word_of(x)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, x in enumerate(re.findall(r"\S+|\s+", t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["line_id", "pos", "token", "word"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x if r is None else repaired(x, r) for x, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], names=["line_id", "pos", "token"])

    # too many to hold: the words of the lines meet them by join
    words = lines.select(F.col("line_id").cast("bigint").alias("line_id"), "text").mapInArrow(split, "line_id bigint, pos int, token string, word string")
    words = words.join(known, "word", "left").select("line_id", "pos", "token", "right").mapInArrow(mend, "line_id bigint, pos int, token string")
    texts = words.groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("text"))
    return lines.drop("text").join(texts, "line_id").select(*lines.columns)


def chained(links: DataFrame) -> DataFrame:
    """(block_id, root): for every block that continues another the first block of its chain. ``links``: block_id, next_id.

    A block continues at most one other, further on in reading order; every round doubles the reach, so there are about
    as many as the logarithm of the longest chain.
    """
    up = written(links.select(F.col("next_id").alias("block_id"), F.col("block_id").alias("root")), "chains")
    while True:
        above = up.select(F.col("block_id").alias("root"), F.col("root").alias("above"))
        far = written(up.join(above, "root", "left"), "chains")
        up = far.select("block_id", F.coalesce("above", "root").alias("root"))
        if far.where("above is not null").isEmpty():
            return up


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, text): repaired running text of every block that is not only furniture.

    Blocks that continue a broken word of another have no row of their own: their text goes on in that of the first
    block of the chain. Where several blocks could be continued by the same one, the nearest is; the others keep their hyphen.
    """
    p = Params()
    kinds, bad = noise(spark, sf_dir, p)
    kinds = written(kinds, "noise")
    lines = lines_of(spark, sf_dir).select("line_id", "block_id", "line_no", "text").dropDuplicates(["line_id"]).where("block_id is not null")
    broken = kinds.where("kind = 'hyphen'").select("line_id", "next_id")
    order = table(spark, sf_dir, "blocks").where("block_id is not null").groupBy("block_id").agg(F.max(F.struct("page_no", "block_idx")).alias("place"))
    links = lines.select("line_id", "block_id").join(broken.where("next_id is not null"), "line_id").join(order, "block_id", "left")
    links = links.groupBy("next_id").agg(F.max(F.struct("place", "block_id", "line_id")).alias("s")).select("next_id", "s.block_id", "s.line_id")
    links = written(links, "links")
    roots = chained(links)
    joined = broken.where("next_id is null").select("line_id").unionByName(links.select("line_id")).withColumn("broken", F.lit(True))
    lines = corrected(lines, bad, p)
    lines = lines.join(kinds.where("kind in ('header', 'pageno')").select("line_id"), "line_id", "left_anti")
    lines = lines.join(joined, "line_id", "left").join(roots, "block_id", "left").join(order, "block_id", "left").withColumn("root", F.coalesce("root", "block_id"))
    place = ["place", "block_id", "line_no", "line_id"]
    by = Window.partitionBy("root").orderBy(*place)
    body = F.when(F.col("broken"), F.regexp_replace("text", rf"[{HYPHENS}]\s*$", "")).otherwise(F.trim("text"))
    glue = F.when(F.lag("line_id").over(by).isNull() | F.coalesce(F.lag("broken").over(by), F.lit(False)), F.lit("")).otherwise(F.lit(" "))
    flow = lines.select("root", F.struct(*place, F.concat(glue, body).alias("piece")).alias("s"))
    return flow.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["piece"]), "").alias("text")).withColumnRenamed("root", "block_id")
