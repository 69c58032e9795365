"""Problem 7: one consistent form for text that looks the same.

The vocabulary of clean spellings (no ignorables, no compatibility forms, one script, seen ``Params.min_count`` times) is
counted over all texts, whole. It is partitioned by the first two look-alike classes of a spelling; each part becomes a
trie over classes, and every distinct token of the part is walked through it by a weighted edit automaton: look-alikes and
ignorables cost nothing, a letter of another script that only resembles the one it stands for costs one, and no more than
``Params.budget`` is spent, only on tokens that mix scripts. The cheapest and then most frequent spelling reached is the
canonical one; tokens that reach nothing keep the form of the table (ignorables leave, each character becomes the
representative of its class). White space of any width is one space.

Two texts look the same when their canonical token sequences have equal classes; that is compared by a 128-bit hash. The
spellings chosen decide the hash wherever the automaton paid for a letter. Classes of equal-looking blocks come as
membership (``p7_members``) with a bounded number of rows; ``p7_found`` lists their pairs, as many as its definition has.
The table of tokens with a spelling of their own is broadcast within ``Params.broadcast_tokens``; beyond that texts are
split, joined with it and put together again.

Null and empty texts stay as they are and form no pairs. Exact copies are no pair (same characters). Repeated rows of a
block count once. The whole text counts.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import written
from .common import table


@dataclass(frozen=True)
class Params:
    min_count: int = 3  # a spelling of the vocabulary is seen so often
    budget: int = 1
    broadcast_tokens: int = 1_000_000  # tokens with a spelling of their own that may be broadcast
    cache: int = 300_000
    min_chars: int = 80


#: Letters drawn alike, each line the Latin representative and what looks like it.
ALIKE = """a а α; c с ϲ; e е; i і ι; j ј; o о ο; p р ρ; s ѕ; x х χ; y у; h һ; d ԁ; q ԛ; w ԝ; v ѵ ν; k к κ;
A А Α; B В Β; C С Ϲ; E Е Ε; H Н Η; I І Ι; J Ј; K К Κ; M М Μ; N Ν; O О Ο; P Р Ρ; S Ѕ; T Т Τ; X Х Χ; Y У Υ Ү; Z Ζ; - ‐ ‑"""
#: Look-alikes that differ visibly in common type: they cost one in the automaton and are kept apart by the table.
DISTINCT = "αικρχкУ"
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
PLAIN = re.compile(r"[!-~\s]*")
RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")


def _classes() -> dict[int, str]:
    out: dict[int, str] = {}
    for line in ALIKE.replace("\n", " ").split(";"):
        first, *rest = line.split()
        for c in rest:
            if c not in DISTINCT:
                out[ord(c)] = first
    for c in [*range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]:  # ligatures and forms of other width
        out[c] = unicodedata.normalize("NFKC", chr(c))
    return out


CLASS = _classes()


def representative(token: str) -> str:
    """Class representatives of a token's visible characters: equal for tokens that look the same, and only for those."""
    # composed twice: a look-alike base may only compose with its mark once it is replaced
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", IGNORABLE.sub("", token)).translate(CLASS))


def clean(token: str) -> bool:
    """A spelling fit for the vocabulary: composed, without ignorables or compatibility forms, letters of one script."""
    if not token or not token.isalpha() or IGNORABLE.search(token) or unicodedata.normalize("NFC", token) != token:
        return False
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in token}
    return len(scripts) == 1 and not scripts & {"FULLWIDTH", "HALFWIDTH"} and not any(0xFB00 <= ord(c) <= 0xFB06 for c in token)


LOOSE = {c: line.split()[0] for line in ALIKE.replace("\n", " ").split(";") for c in line.split()[1:] if c in DISTINCT}


def mixed(token: str) -> bool:
    """Letters of more than one of the scripts that have look-alikes."""
    return len({k for c in token if c.isalpha() and (k := unicodedata.name(c, "?").split(" ")[0]) in ("LATIN", "CYRILLIC", "GREEK")}) > 1


class Trie:
    """Trie over look-alike classes; a node is a dict of class -> node, its spelling and count under the empty key."""

    def __init__(self, counts: list[tuple[str, int]] = ()):
        self.root: dict = {}
        for word, n in counts:
            self.add(word, n)

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in representative(word):
            node = node.setdefault(c, {})
        if "" not in node or (-n, word) < node[""]:
            node[""] = (-n, word)  # the most frequent spelling of a class comes first

    def find(self, token: str, budget: int = 1) -> tuple[int, str] | None:
        """(cost, spelling) of the cheapest, then most frequent, spelling that the token looks like.

        The automaton's states are nodes with the cost spent so far. A character moves along its class at no cost, an
        ignorable one stays; a letter that resembles another of its script's neighbour moves along that one's class for one.
        """
        spend = budget if budget and mixed(token) else 0
        states: list[tuple[dict, int]] = [(self.root, 0)]
        for c in unicodedata.normalize("NFC", token):
            step = representative(c)  # '' for ignorables, several classes for ligatures
            after: dict[int, tuple[dict, int]] = {}
            for node, cost in states:
                moves = [(step, cost)]
                if cost < spend and c in LOOSE:
                    moves.append((LOOSE[c], cost + 1))
                for classes, price in moves:
                    at = node
                    for k in classes:
                        at = at.get(k)
                        if at is None:
                            break
                    if at is not None and (id(at) not in after or after[id(at)][1] > price):
                        after[id(at)] = (at, price)
            states = list(after.values())
            if not states:
                return None
        ends = [(cost, *node[""]) for node, cost in states if "" in node]
        if not ends:
            return None
        cost, _, word = min(ends)
        return cost, word


def parts(token: str) -> list[str]:
    """Parts of the vocabulary that may hold a spelling of the token: its first two classes, and those a loose letter may stand for."""
    shape = representative(token)
    firsts = [[c, LOOSE[c]] if c in LOOSE else [c] for c in shape[:2]]
    return sorted({"".join(x) for x in itertools.product(*firsts)})


class Canonicalizer:
    """Applies the chosen spellings. ``chosen``: token (alphabetic run) -> spelling."""

    def __init__(self, chosen: dict[str, str], cache: int):
        self.chosen, self.cache, self.limit = chosen, {}, cache

    def token(self, token: str) -> tuple[str, str]:
        """(canonical spelling, key). The key is the same for all tokens that look the same."""
        form, key = [], []
        for run in runs_of(token):
            hit = self.chosen.get(run)
            form.append(hit if hit is not None else _by_script(run))
            key.append(representative(run if hit is None else hit))
        return unicodedata.normalize("NFC", "".join(form)), unicodedata.normalize("NFC", "".join(key))

    def text(self, text: str, part: int) -> str:
        cache, out = self.cache, []
        for t in text.split():
            hit = cache.get(t)
            if hit is None:
                if len(cache) >= self.limit:
                    cache.clear()
                hit = cache[t] = self.token(t)
            if hit[part]:
                out.append(hit[part])
        return " ".join(out)


def runs_of(token: str) -> list[str]:
    """Alphabetic and other runs of a token without ignorables."""
    return RUNS.findall(IGNORABLE.sub("", unicodedata.normalize("NFC", token)))


CYRILLIC = {ord(line.split()[0]): c for line in ALIKE.replace("\n", " ").split(";") for c in line.split()[1:] if "CYRILLIC" in unicodedata.name(c, "") and c not in DISTINCT}


def _by_script(run: str) -> str:
    """Table form of an unmatched run: representatives, drawn back to Cyrillic when its unambiguous letters are Cyrillic."""
    plain = representative(run)
    if any("Ѐ" <= c <= "ӿ" for c in plain) and not any(c.isascii() and c.isalpha() and ord(c) not in CYRILLIC for c in plain):
        return plain.translate(CYRILLIC)
    return plain


def token_counts(df: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n): counts of all alphabetic runs of all texts. ``df``: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            split: Counter[str] = Counter()
            for t, n in words.items():
                for run in runs_of(t):
                    if run[0].isalpha():
                        split[run] += n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(split), pa.string()), pa.array(list(split.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(t.split())
            if len(words) > p.cache:
                yield flush()
        yield flush()

    return df.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def chosen_spellings(counts: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, spelling, cost) of every token whose canonical spelling is not the table's form of it. ``counts``: word, n.

    Spellings and tokens of a part of the vocabulary meet in one task, spellings first, so that only the trie of one part
    is held while any number of tokens passes through it.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shape = representative(w)
                if not shape:
                    continue
                if n >= p.min_count and clean(w):
                    rows.append((shape[:2], 0, w, n))
                rows += [(k, 1, w, n) for k in parts(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["part", "side", "word", "n"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trie = None, Trie()
        for b in batches:
            out: list[tuple[str, str, int]] = []
            for k, side, w, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != part:
                    part, trie = k, Trie()
                if side == 0:
                    trie.add(w, n)
                else:
                    hit = trie.find(w, p.budget)
                    if hit is not None and hit[1] != _by_script(w):
                        out.append((w, hit[1], hit[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["word", "spelling", "cost"])

    placed = counts.mapInArrow(place, "part string, side int, word string, n bigint").repartition("part").sortWithinPartitions("part", "side")
    found = placed.mapInArrow(walk, "word string, spelling string, cost int")
    return found.groupBy("word").agg(F.min(F.struct("cost", "spelling")).alias("s")).select("word", "s.spelling", "s.cost")


def _applied(df: DataFrame, chosen: DataFrame, part: int, p: Params) -> DataFrame:
    """(id, text, look): ``df``'s texts and their canonical form (part 0) or key (part 1)."""
    chosen = written(chosen, "spellings")
    src = df.select(F.col("id").cast("bigint").alias("id"), "text")
    if chosen.count() <= p.broadcast_tokens:
        shared = df.sparkSession.sparkContext.broadcast({r.word: r.spelling for r in chosen.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            canon = Canonicalizer(shared.value, p.cache)
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else canon.text(t, part) for t in b.column(1).to_pylist()], pa.string())], names=["id", "text", "look"])

        return src.mapInArrow(run, "id bigint, text string, look string")

    # too many to hold: the runs of all tokens meet their spellings by join
    src = written(src.withColumn("row", F.monotonically_increasing_id()), "texts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, j, k, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for j, x in enumerate(t.split()) for k, w in enumerate(runs_of(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["row", "token", "run", "word"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [unicodedata.normalize("NFC", "".join((h or _by_script(w)) if part == 0 else representative(h or w) for w, h in zip(ws, hs))) for ws, hs in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], names=["row", "token", "t"])

    words = src.where("text is not null").select("row", "text").mapInArrow(split, "row bigint, token int, run int, word string").join(chosen.select("word", "spelling"), "word", "left")
    tokens = words.groupBy("row", "token").agg(F.array_sort(F.collect_list(F.struct("run", "word", "spelling"))).alias("rs")).select("row", "token", F.col("rs.word").alias("ws"), F.col("rs.spelling").alias("hs"))
    tokens = tokens.mapInArrow(spell, "row bigint, token int, t string").where("t <> ''")
    looks = tokens.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token", "t"))), lambda x: x["t"]), " ").alias("look"))
    return src.join(looks, "row", "left").select("id", "text", F.when(F.col("text").isNotNull(), F.coalesce("look", F.lit(""))).alias("look"))


def keys(df: DataFrame, p: Params = Params()) -> DataFrame:
    """(id, key, raw): hash of the canonical form and of the characters as they are. ``df``: id, text."""
    df = df.where("text is not null")
    # a spelling decides a key only where the automaton paid for a letter: the others have the token's own classes
    chosen = chosen_spellings(token_counts(df, p), p).where("cost > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [xxhash.xxh3_128_digest(t) for t in b.column(2).to_pylist()]
            raw = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.int64())], names=["id", "key", "raw"])

    return _applied(df, chosen, 1, p).mapInArrow(run, "id bigint, key binary, raw bigint")


def members(df: DataFrame, p: Params = Params()) -> DataFrame:
    """(id, class_id, spelling_id, spellings, copies) of every text that looks like one of other characters.

    ``class_id`` and ``spelling_id`` are the least ids of the texts that look the same and of those with the same
    characters; ``spellings`` counts the latter in the class, ``copies`` its texts. One row per text, whatever the size of a class.
    """
    k = written(keys(df, p).distinct(), "looks")
    spelt = k.groupBy("key", "raw").agg(F.min("id").alias("spelling_id"), F.count(F.lit(1)).alias("n"))
    classes = spelt.groupBy("key").agg(F.min("spelling_id").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("copies")).where("spellings > 1")
    k = written(k.join(classes, "key"), "looks-mixed")
    return k.join(k.groupBy("key", "raw").agg(F.min("id").alias("spelling_id")), ["key", "raw"]).select("id", "class_id", "spelling_id", "spellings", "copies")


def same_looking(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Pairs (a, b), a < b, of ids whose texts look the same but are not the same characters."""
    k = written(members(df, p).select("id", "class_id", "spelling_id"), "looks-members")
    a, b = k.alias("a"), k.alias("b")
    return a.join(b, F.expr("a.class_id = b.class_id and a.id < b.id and a.spelling_id <> b.spelling_id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def block_texts(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    return table(spark, sf_dir, "blocks").select(F.col("block_id").alias("id"), "text").where((F.length("text") >= least) & F.col("id").isNotNull())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    return same_looking(block_texts(spark, sf_dir, p.min_chars), p).select(F.col("a").alias("block_a"), F.col("b").alias("block_b")).distinct()


def p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every block that looks like one of other characters."""
    p = Params()
    return members(block_texts(spark, sf_dir, p.min_chars), p).withColumnRenamed("id", "block_id").distinct()


def canonical_texts(df: DataFrame, p: Params = Params()) -> DataFrame:
    """``df``: id, text -> id, text in its canonical form."""
    out = _applied(df, chosen_spellings(token_counts(df, p), p), 0, p)
    return out.select("id", F.col("look").alias("text"))


def p7_canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form of every recognized line."""
    lines = table(spark, sf_dir, "text_lines").select(F.col("line_id").alias("id"), "text")
    return canonical_texts(lines).select(F.col("id").alias("line_id"), "text")
