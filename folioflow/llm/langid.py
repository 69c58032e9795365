"""Problem 1: language of every record and of every stretch inside mixed records.

Method: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy, with
calibrated rejection. Because both the averaging and the softmax's input are linear, a word adds a fixed vector of class
scores; workers keep those vectors per word, so a sentence costs one lookup per word.

Training uses a bounded sample of labelled documents (``Params.sample_docs``), chosen by hash; labels may be wrong, so
after a first pass the sentences the model contradicts strongly are left out and training starts again. Temperature and
the threshold of rejection come from sentences held out. A stretch is rejected (no language) when its calibrated
probability is under ``Params.min_prob`` or when too few of its subwords were ever seen in training, which is what
happens with mojibake, tables of figures and random characters.

Null and empty texts get no language and no row; a record whose text is rejected altogether has a row without a language. Repeated rows change nothing, since counts only rank languages of one
record. Every document and block is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import written
from .common import LANG_CODES, LANGS, table


@dataclass(frozen=True)
class Params:
    sample_docs: int = 2000  # bound of the labelled sample
    sentences_per_doc: int = 5
    buckets: int = 1 << 16
    dim: int = 16
    epochs: int = 3
    rate: float = 0.5
    min_prob: float = 0.9
    precision: float = 0.998  # share of right answers wanted among held-out stretches that are not rejected
    context_prob: float = 0.995
    min_known: float = 0.55
    min_words: int = 4
    cache_words: int = 400_000


LENGTHS = np.array([0, 5, 7, 10])  # lower ends of the length classes of the rejection, in words
WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*|[ऀ-ॿ]+|[฀-๿]+")
#: A sentence ends at an end mark before a new capital, a script without case, or a blank line.
SPLIT = re.compile(r"(?<=[.!?؟।…»”\"“)])\s+(?=[^\W\da-zа-яёіїєґß-öø-ÿ]|[«„“\"¿¡])|(?<=[。！？])(?![”」』])|\n\s*\n")
ENDED = re.compile(r"[.!?؟।…。！？][\"”»“)」』\s]*$|[฀-๿]\s*$")
SCRIPTS = (("th", "฀", "๿"), ("hi", "ऀ", "ॿ"), ("ar", "؀", "ۿ"), ("ja", "぀", "ヿ"), ("zh", "㐀", "鿿"))


def subwords(word: str, buckets: int) -> list[int]:
    """Hash buckets of the character n-grams of a word and of the word itself, plus its script."""
    w = f"<{word}>"
    grams = [w]
    for n in (2, 3, 4):
        grams += [w[i : i + n] for i in range(len(w) - n + 1)]
    kana = any("぀" <= c <= "ヿ" for c in word)
    for lang, lo, hi in SCRIPTS:
        if lo <= word[0] <= hi or (lang == "ja" and kana):
            grams += [f"#{'ja' if kana else lang}"] * 4
            break
    return [zlib.crc32(g.encode()) % buckets for g in grams]


def pieces(text: str) -> list[str]:
    return [s for s in SPLIT.split(text) if s and not s.isspace()]


def label_of(code: str | None) -> str | None:
    return LANG_CODES.get(re.split(r"[-_]", (code or "").strip().lower())[0])


@dataclass
class Model:
    scores: np.ndarray  # buckets x classes
    known: np.ndarray  # buckets
    bias: np.ndarray
    temperature: float
    floor: np.ndarray  # least probability by length
    params: Params


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), np.int64, int(lens.sum())), lens


def _sgd(feats: list[np.ndarray], y: np.ndarray, p: Params, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    emb = rng.normal(0, 0.1, (p.buckets, p.dim)).astype(np.float32)
    w = np.zeros((len(LANGS), p.dim), np.float32)
    w += rng.normal(0, 0.1, w.shape)
    b = np.zeros(len(LANGS), np.float32)
    eye = np.eye(len(LANGS), dtype=np.float32)
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(order), 32):
            take = order[at : at + 32]
            idx = np.concatenate([feats[i] for i in take])
            lens = np.array([len(feats[i]) for i in take])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            mean = np.add.reduceat(emb[idx], starts, axis=0) / lens[:, None]
            grad = _softmax(mean @ w.T + b) - eye[y[take]]
            g_mean = grad @ w
            w -= rate * grad.T @ mean
            b -= rate * 0.1 * grad.sum(0)
            by = np.argsort(idx, kind="stable")  # sums per bucket, much faster than adding one by one
            same = idx[by]
            first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            step = (-8 * rate * g_mean / lens[:, None]).astype(np.float32)
            emb[same[first]] += np.add.reduceat(step[np.repeat(np.arange(len(lens)), lens)[by]], first, axis=0)
    return emb, w, b


def train(pairs: list[tuple[str, str]], seeds: list[tuple[str, str]], p: Params = Params()) -> Model:
    """``pairs``: (text, language) of the sample, labels possibly wrong; ``seeds``: (word, language) sure ones."""
    rng = np.random.default_rng(7)
    cache: dict[str, list[int]] = {}

    def features(words: list[str]) -> np.ndarray:
        out: list[int] = []
        for w in words:
            g = cache.get(w)
            if g is None:
                g = cache[w] = subwords(w, p.buckets)
            out += g
        return np.array(out, np.int64)

    feats, ys, lens = [], [], []
    for text, lang in pairs:
        sents = [s for s in pieces(text) if ENDED.search(s)]
        for s in sents[:: max(1, len(sents) // p.sentences_per_doc)]:
            words = [w.lower() for w in WORD.findall(s)]
            if len(words) >= 3 or words and words[0][0] > "؀":
                feats.append(features(words))
                ys.append(LANGS.index(lang))
                lens.append(len(words))
                if len(words) > 6:  # short stretches are seen in training too, else they come out overconfident
                    at, n = int(rng.integers(0, len(words) - 5)), int(rng.integers(3, 6))
                    feats.append(features(words[at : at + n]))
                    ys.append(LANGS.index(lang))
                    lens.append(n)
    for word, lang in seeds:
        feats.append(features([word.lower()]))
        ys.append(LANGS.index(lang))
    for lang, lo, hi in SCRIPTS:  # classes that a small sample may lack are still known by their script
        for _ in range(5):
            feats.append(features(["".join(chr(rng.integers(ord(lo) + 1, ord(hi))) for _ in range(3))]))
            ys.append(LANGS.index(lang))
    y = np.array(ys)
    size = np.array(lens + [1] * (len(y) - len(lens)))
    held = rng.random(len(y)) < 0.1
    held[-len(seeds) - 25 :] = False
    fit = np.flatnonzero(~held)
    emb, w, b = _sgd([feats[i] for i in fit], y[fit], p, rng)

    def logits(emb: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([emb[f].mean(0) @ w.T + b for f in feats])

    prob = _softmax(logits(emb, w, b))
    agree = prob[np.arange(len(y)), y] > 0.2  # wrong labels leave
    fit = np.flatnonzero(~held & agree)
    emb, w, b = _sgd([feats[i] for i in fit], y[fit], p, rng)
    z = logits(emb, w, b)
    check = np.flatnonzero(held & agree)
    temperature = 1.0
    if len(check):
        losses = {t: -np.log(_softmax(z[check] / t)[np.arange(len(check)), y[check]] + 1e-9).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
        temperature = min(losses, key=losses.get)
    floor = np.full(len(LENGTHS), p.min_prob)
    for k in range(len(LENGTHS)):  # each length needs the probability at which the held-out stretches of that length are right
        part = check[np.searchsorted(LENGTHS, size[check], side="right") - 1 == k]
        if len(part) > 50:
            q = _softmax(z[part] / temperature)
            right, top = q.argmax(1) == y[part], q.max(1)
            fit_t = [t for t in (p.min_prob, 0.95, 0.97, 0.98, 0.99, 0.995, 0.998, 0.999) if right[top >= t].mean() >= p.precision]
            floor[k] = fit_t[0] if fit_t else 0.999
    known = np.zeros(p.buckets, bool)
    for i in fit:
        known[feats[i]] = True
    emb[~known] = 0
    return Model((emb @ w.T).astype(np.float32), known, b, temperature, floor, p)


class Scorer:
    """Worker side: word vectors are computed once and kept up to a bound."""

    def __init__(self, model: Model):
        self.m, self.index, self.rows = model, {}, []
        self.grid = np.zeros((1024, len(LANGS) + 2), np.float32)

    def _add(self, word: str) -> int:
        if len(self.index) >= self.m.params.cache_words:
            self.index.clear()
        g = subwords(word.lower(), self.m.params.buckets)
        i = len(self.index)
        if i >= len(self.grid):
            self.grid = np.concatenate([self.grid, np.zeros_like(self.grid)])
        self.grid[i, :-2] = self.m.scores[g].sum(0)
        self.grid[i, -2] = len(g)
        self.grid[i, -1] = self.m.known[g].sum()
        self.index[word] = i
        return i

    def score(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best class (-1: rejected), its calibrated probability, and the number of words."""
        n = len(sentences)
        lang, prob, count = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
        for at in range(0, n, 20_000):
            part = sentences[at : at + 20_000]
            if len(self.index) > self.m.params.cache_words * 0.8:
                self.index.clear()
            index, add, find = self.index, self._add, WORD.findall
            ids: list[int] = []
            lens = np.zeros(len(part), np.int64)
            for k, s in enumerate(part):
                words = find(s)
                lens[k] = len(words)
                for w in words:
                    i = index.get(w)
                    ids.append(add(w) if i is None else i)
            if not ids:
                continue
            has = np.flatnonzero(lens)
            starts = np.concatenate([[0], np.cumsum(lens[has])[:-1]])
            sums = np.add.reduceat(self.grid[np.array(ids)], starts, axis=0)
            p = _softmax((sums[:, :-2] / sums[:, -2:-1] + self.m.bias) / self.m.temperature)
            best = p.argmax(1)
            top = p[np.arange(len(best)), best]
            ok = (top >= self.m.floor[np.searchsorted(LENGTHS, lens[has], side="right") - 1]) & (sums[:, -1] / sums[:, -2] >= self.m.params.min_known)
            lang[at + has] = np.where(ok, best, -1)
            prob[at + has] = top
            count[at + has] = lens[has]
        return lang, prob, count


_MODELS: dict[tuple, Model] = {}


def fit(spark: SparkSession, sf_dir: str, p: Params = Params()) -> Model:
    """Train on at most ``p.sample_docs`` labelled documents, those of least hash in the whole table.

    A session trains once for the same state of the tables: the model is kept under their paths, counts and parameters.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    n = docs.count()
    key = (spark.sparkContext.applicationId, sf_dir, n, p)
    if key in _MODELS:
        return _MODELS[key]
    share = 1.1 * (p.sample_docs + 100) / max(n, 1)
    # a hash spread over the doubles from 0 to 1: the share may be as small as a double can be
    spread = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    part = docs.where(spread < share) if share < 1 else docs
    rows = part.orderBy(spread, "doc_id").limit(p.sample_docs).collect()
    pairs = [(r.text, lang) for r in rows if r.text and (lang := label_of(r.lang))]
    words = table(spark, sf_dir, "common_words").select("lang", "word").where(F.col("lang").isin(*LANGS) & F.col("word").isNotNull()).distinct()
    seeds = [(r.word, r.lang) for r in words.orderBy("lang", "word").collect()]
    while len(_MODELS) >= 8:
        _MODELS.pop(next(iter(_MODELS)))
    model = _MODELS[key] = train(pairs, seeds, p)
    return model


def language_counts(df: DataFrame, model: Model) -> DataFrame:
    """``df``: tbl, rec_id, text. Rows (tbl, rec_id, lang, whole, chars, prob): whole sentences, characters and mean probability by language."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    min_words, context = model.params.min_words, model.params.context_prob

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            sents: list[str] = []
            owner: list[int] = []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t:
                    part = pieces(t)
                    sents += part
                    owner += [i] * len(part)
            if not sents:
                continue
            lang, prob, words = scorer.score(sents)
            own = np.array(owner, np.int64)
            tally = np.bincount(own[lang >= 0] * len(LANGS) + lang[lang >= 0], words[lang >= 0], b.num_rows * len(LANGS)).reshape(-1, len(LANGS))
            stray = (lang != tally.argmax(1)[own]) & (words < 8) & (prob < context)  # a short stretch against its context needs more proof
            lang = np.where(stray, -1, lang)
            size = np.fromiter(map(len, sents), np.int64, len(sents))
            spaced = lang < LANGS.index("zh")
            long_enough = np.where(spaced, words >= min_words, size >= 6) | (words >= min_words)
            whole = np.fromiter((ENDED.search(s) is not None for s in sents), bool, len(sents)) & long_enough
            ok = np.flatnonzero(lang >= 0)
            key = own[ok] * len(LANGS) + lang[ok]
            uniq, back = np.unique(key, return_inverse=True)
            w = np.bincount(back, whole[ok], len(uniq)).astype(np.int64)
            c = np.bincount(back, size[ok], len(uniq)).astype(np.int64)
            q = np.bincount(back, prob[ok] * size[ok], len(uniq))
            rows = pa.array(uniq // len(LANGS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array([LANGS[k] for k in uniq % len(LANGS)], pa.string()), pa.array(w), pa.array(c), pa.array(q)],
                names=["tbl", "rec_id", "lang", "whole", "chars", "mass"],
            )

    raw = df.select("tbl", F.col("rec_id").cast("bigint").alias("rec_id"), "text").mapInArrow(count, "tbl string, rec_id bigint, lang string, whole bigint, chars bigint, mass double")
    return raw.groupBy("tbl", "rec_id", "lang").agg(F.sum("whole").alias("whole"), F.sum("chars").alias("chars"), (F.sum("mass") / F.sum("chars")).alias("prob"))


def _file_label(path: str):
    """Language code among the parts of a path; a region after a code is not a code itself. Null when there is none."""
    codes = F.create_map(*[F.lit(x) for kv in LANG_CODES.items() for x in kv])
    parts = F.split(F.lower(F.col(path)), r"[/_.\-]")
    return F.get(F.filter(F.transform(parts, lambda x: F.try_element_at(codes, x)), lambda x: x.isNotNull()), F.lit(0))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id, label): one row per record; label null when missing or unknown."""
    codes = F.create_map(*[F.lit(x) for kv in LANG_CODES.items() for x in kv])
    ex = table(spark, sf_dir, "extractions").where("extraction_id is not null")
    ex = ex.groupBy(F.col("extraction_id").alias("rec_id")).agg(F.max_by(_file_label("input_file"), F.coalesce("received_at", F.lit("1900-01-01").cast("timestamp"))).alias("label"))
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("rec_id"), F.try_element_at(codes, F.get(F.split(F.lower(F.trim("lang")), "[-_]"), F.lit(0))).alias("label"))
    return ex.select(F.lit("extractions").alias("tbl"), "rec_id", "label").unionByName(docs.select(F.lit("documents").alias("tbl"), "rec_id", "label"))


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").select(F.lit("extractions").alias("tbl"), F.col("extraction_id").alias("rec_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text")
    return blocks.unionByName(docs).where("rec_id is not null and length(text) > 0")


def record_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with text: main language with confidence (null where all its text is rejected), languages with whole sentences, label."""
    texts = record_texts(spark, sf_dir)
    counts = language_counts(texts, fit(spark, sf_dir))
    # a record whose every stretch is rejected still has its row
    counts = counts.unionByName(texts.select("tbl", F.col("rec_id").cast("bigint").alias("rec_id")).distinct(), allowMissingColumns=True)
    per = counts.groupBy("tbl", "rec_id").agg(
        F.max_by("lang", F.struct("chars", "lang")).alias("lang"),
        F.max_by("prob", F.struct("chars", "lang")).alias("confidence"),
        F.sort_array(F.collect_list(F.when(F.col("whole") > 0, F.col("lang")))).alias("langs"),
    )
    return per.join(labels(spark, sf_dir), ["tbl", "rec_id"], "left")


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = record_languages(spark, sf_dir)
    return rec.select("tbl", "rec_id", "lang", F.round("confidence", 4).alias("confidence"), F.array_join("langs", ",").alias("langs"), "label")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = record_languages(spark, sf_dir)
    case = rec.where(F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.size("langs") > 1))
    return case.select("tbl", "rec_id", F.explode("langs").alias("lang")).distinct()


SCORED = "tbl string, rec_id bigint, block_id bigint, ends array<int>, langs array<int>, probs array<double>, words array<double>, totals array<double>"
STRETCH = "tbl string, rec_id bigint, block_id bigint, start_char int, end_char int, lang string, confidence double"


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one language in texts that hold another than the main one of their record.

    (tbl, rec_id, block_id, start_char, end_char, lang, confidence): positions are those in the document's text, or in the
    text of the extraction's block; block_id is null for documents. A text that holds several languages gives all its
    stretches, a block wholly in another language than its extraction gives the one. Texts are scored once; only spans
    are written and joined.
    """
    shared = spark.sparkContext.broadcast(fit(spark, sf_dir))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            ends, langs, probs, counts, totals = [], [], [], [], []
            for t in b.column(3).to_pylist():
                bounds = [0, *(m.end() for m in SPLIT.finditer(t)), len(t)]
                spans = [(x, y) for x, y in zip(bounds, bounds[1:]) if y > x]
                lang, prob, words = scorer.score([t[x:y] for x, y in spans])
                ends.append([y for _, y in spans])
                langs.append(lang.tolist())
                probs.append(prob.tolist())
                counts.append(words.tolist())
                totals.append(np.bincount(lang[lang >= 0], words[lang >= 0], len(LANGS)).tolist())
            ints, floats = pa.list_(pa.int32()), pa.list_(pa.float64())
            cols = [pa.array(ends, ints), pa.array(langs, ints), pa.array(probs, floats), pa.array(counts, floats), pa.array(totals, floats)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names=["tbl", "rec_id", "block_id", "ends", "langs", "probs", "words", "totals"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.params
        for b in batches:
            out: list[tuple] = []
            for x in b.to_pylist():
                runs: list[list] = []
                start = 0
                for y, k, q, n in zip(x["ends"], x["langs"], x["probs"], x["words"]):
                    if k != x["main"] and n < 8 and q < p.context_prob or k < 0 or n < p.min_words and k < LANGS.index("zh"):
                        if runs:
                            runs[-1][1] = y
                    elif runs and runs[-1][2] == k:
                        runs[-1][1] = y
                        runs[-1][3].append(q)
                    else:
                        runs.append([start, y, k, [q]])
                    start = y
                if len(runs) > 1 or runs and runs[0][2] != x["main"]:
                    out += [(x["tbl"], x["rec_id"], x["block_id"], r[0], r[1], LANGS[r[2]], round(float(np.mean(r[3])), 4)) for r in runs]
            names = [c.split()[0] for c in STRETCH.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema(list(zip(names, kinds))))

    blocks = table(spark, sf_dir, "blocks").select(F.lit("extractions").alias("tbl"), F.col("extraction_id").alias("rec_id"), "block_id", "text")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), F.lit(None).cast("bigint").alias("block_id"), "text")
    texts = blocks.unionByName(docs).where("rec_id is not null and length(text) > 0")
    scored = written(texts.mapInArrow(score, SCORED).distinct(), "stretches")
    sums = scored.select("tbl", "rec_id", F.posexplode("totals").alias("k", "n")).where("n > 0").groupBy("tbl", "rec_id", "k").agg(F.sum("n").alias("n"))
    main = sums.groupBy("tbl", "rec_id").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("main"))
    return scored.drop("totals").join(main, ["tbl", "rec_id"]).mapInArrow(cut, STRETCH)
