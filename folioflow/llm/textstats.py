"""Problem 3: text statistics and the kind of content they indicate.

Every statistic is measured on every text, whole: one pass splits it into tokens, what a token adds is worked out once per
distinct token and kept on the worker, and texts are sums over their tokens. Thresholds on the statistics are noisy
labelling functions: each fires for one kind (prose, list, table, junk) or abstains. How far each function can be trusted
is learned by expectation-maximization from how the functions agree over all texts; the only thing that leaves the
executors for that is the count of every pattern of votes, of which there are at most ``2 ** len(VOTES)``. The result is
the posterior probability of each kind.

Null and empty texts have zero statistics and kind null. Repeated rows are counted once per distinct key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import written
from .common import table

KINDS = ("prose", "list", "table", "junk")


#: What a token adds to its text: name and pattern, counted in the token.
COUNTED = {
    "n_digits": r"\p{Nd}",
    "n_letters": r"[\p{L}\p{M}]",
    "n_pipes": r"\|",
    "n_cells": r"</?t",
    "n_ends": r"[\p{L}\p{M}]{2}[)»”\"’]?[.!?。！？।؟…]+(?=[»”\"’)]|$|[\p{Lo}\p{Lu}])",
    "n_moji": r"[ÐÑÃÂ�□■]",
    "n_numbers": r"(?:^|[|>])[+-]?\d+(?:[.,]\d+)*%?(?=[|<]|$)",
    "n_delimited": r"[;,]\d+(?:\.\d+)?%?(?=[;,]|$)",
    "n_long": r"(?=\S*\d)(?=\S*\p{Lu})[\p{L}\d+/=]{24,}",
    "n_mixed": r"\p{Ll}\d\p{L}|\p{Lu}\d\p{L}|\p{L}\d\p{Lu}",
    "n_repeats": r"([^\s.])\1{9,}",
    "n_unspaced": r"[\p{Lo}\p{Mn}\p{Mc}]{16,}",
    "n_short": r"^[^\s\p{Lo}]{1,2}$",
    "n_lower": r"^\p{Ll}{4,}(?=[,.;]|$)",
    "n_refs": r"^//$",
    "n_marks": r"^\[\d{1,2}\]",
}
#: Marks of an item that count by the token behind them: a bullet before anything but a figure, a letter or number before a word.
BULLET, LETTERED, WORDY, FIGURED = r"^[•*–—‣◦▪·-]$", r"^\(?(?:\p{L}|\d{1,2})[.)]$", r"^\p{L}{3,}", r"^\d"
LEADERS, GAPS, TABBED, LINE_END = r"(?:\.\s?){4,}\s*\d", r"\S {3,}(?=\S)", r"\t\d+(?:\.\d+)?%?(?=[;,\t\s]|$)", r"[.!?。！？।؟…][»”\"’)]?\s*$"
TOKEN_STATS = [*COUNTED, "n_common"]
STATS = ["n_chars", "n_spaces", "n_words", "n_lines", "n_line_ends", "n_leaders", "n_gaps", "n_bullets", *TOKEN_STATS]
CACHE = 400_000  # distinct tokens kept by a worker


class Meter:
    """Measures texts; the counts of a token are worked out once."""

    def __init__(self, common: frozenset[str] = frozenset()):
        import regex

        self.common = common
        self.counted = [regex.compile(x) for x in COUNTED.values()]
        self.flags = [regex.compile(x) for x in (BULLET, LETTERED, WORDY, FIGURED)]
        self.leaders, self.gaps, self.tabbed, self.line_end, self.parts = (regex.compile(x) for x in (LEADERS, GAPS, TABBED, LINE_END, r"[\p{L}\p{M}’']+"))
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(TOKEN_STATS) + len(self.flags)), np.int32)

    def _id(self, t: str) -> int:
        i = len(self.ids)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for k, pattern in enumerate(self.counted):
            self.rows[i, k] = sum(1 for _ in pattern.finditer(t))
        self.rows[i, len(self.counted)] = sum(w in self.common for w in self.parts.findall(t.lower())) if self.common else 0
        for k, pattern in enumerate(self.flags):
            self.rows[i, len(TOKEN_STATS) + k] = pattern.search(t) is not None
        self.ids[t] = i
        return i

    def measure(self, texts: list[str]) -> np.ndarray:
        """One row of ``STATS`` per text."""
        if len(self.ids) > CACHE:
            self.ids.clear()
        out = np.zeros((len(texts), len(STATS)), np.int64)
        get, add = self.ids.get, self._id
        ids: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            for w in t.split():
                i = get(w)
                ids.append(add(w) if i is None else i)
            ends[k + 1] = len(ids)
            lines = t.split("\n")
            spaces = t.count(" ") + len(lines) - 1
            out[k, :7] = len(t), spaces, ends[k + 1] - ends[k], len(lines), sum(1 for x in lines if self.line_end.search(x)), len(self.leaders.findall(t)) if t.count(".") > 3 else 0, len(self.gaps.findall(t)) if "   " in t else 0
            if "\t" in t:
                out[k, STATS.index("n_delimited")] = len(self.tabbed.findall(t))
        if not ids:
            return out
        m = self.rows[np.array(ids, np.int64)]
        n = len(TOKEN_STATS)
        behind = np.concatenate([m[1:, n:], np.zeros((1, 4), m.dtype)])
        behind[ends[1:][ends[1:] > 0] - 1] = 0  # the last token of a text has none
        has_next = np.ones(len(m), bool)
        has_next[ends[1:][ends[1:] > 0] - 1] = False
        items = (m[:, n] & (behind[:, 3] == 0) & has_next) | (m[:, n + 1] & behind[:, 2])
        full = np.flatnonzero(np.diff(ends))
        sums = np.add.reduceat(np.concatenate([items[:, None], m[:, :n]], axis=1), ends[full], axis=0)
        out[full, 7] = sums[:, 0]
        out[full, 8:] += sums[:, 1:]
        out[:, 7] += out[:, STATS.index("n_marks")]
        return out


def measured(df: DataFrame, common: list[str] | None = None) -> DataFrame:
    """Replace ``text`` by its statistics."""
    rest = [c for c in df.columns if c != "text"]
    shared = df.sparkSession.sparkContext.broadcast(frozenset(common or ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(shared.value)
        for b in batches:
            got = meter.measure([t or "" for t in b.column(len(rest)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(got[:, k]) for k in range(len(STATS)))], names=[*rest, *STATS])

    kinds = dict(df.dtypes)
    return df.select(*rest, "text").mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"{k} bigint" for k in STATS]))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


SENTENCES = "n_ends >= 1 and n_moji <= 0.05 * n_chars and n_chars / greatest(n_ends, 1) < 400"
WORDS = "greatest(n_words, 1)"
SYMBOLS = "(n_chars - n_letters - n_digits - n_spaces)"

#: (name, kind, condition over the statistics)
VOTES = [
    ("sentences", "prose", f"{SENTENCES} and n_letters > 0.65 * n_chars"),
    ("lower_run", "prose", f"n_lower >= 4 and n_lower > 0.25 * {WORDS} and n_ends >= 1"),
    ("few_symbols", "prose", f"{SYMBOLS} < 0.06 * n_chars and n_numbers < 0.2 * {WORDS} and n_ends >= 1 and n_moji <= 0.05 * n_chars"),
    ("several_ends", "prose", "n_ends >= 2 and n_cells = 0 and n_leaders = 0 and n_refs < 2 and n_bullets < 3 and n_moji <= 0.05 * n_chars"),
    ("unspaced", "prose", "n_unspaced >= 2 and n_letters > 0.7 * n_chars and n_numbers < 4"),
    ("bullets", "list", f"n_bullets >= 3 and n_bullets > 0.1 * {WORDS}"),
    ("leaders", "list", "n_leaders >= 2"),
    ("references", "list", "n_refs >= 2"),
    ("no_ends", "list", "n_ends = 0 and n_letters > 0.6 * n_chars and n_gaps < 3 and n_moji = 0 and n_unspaced = 0 and n_repeats = 0 and n_long = 0"),
    ("cells", "table", "n_cells >= 4"),
    ("pipes", "table", "n_pipes >= 4 and n_numbers >= 2 and n_repeats = 0"),
    ("gaps", "table", f"n_gaps >= 3 and n_numbers > 0.2 * {WORDS}"),
    ("numbers", "table", f"n_numbers > 0.5 * {WORDS} and n_numbers >= 6"),
    ("delimited", "table", "n_delimited >= 4"),
    ("repeats", "junk", "n_repeats >= 2"),
    ("mixed", "junk", f"n_mixed > 0.3 * {WORDS} and n_mixed >= 4"),
    ("mojibake", "junk", "n_moji > 0.05 * n_chars"),
    ("random", "junk", "n_long >= 1"),
    ("symbols", "junk", f"{SYMBOLS} > 0.3 * (n_chars - n_spaces) and n_numbers < 0.2 * {WORDS} and n_cells = 0 and n_leaders = 0"),
    ("fragments", "junk", f"n_short > 0.6 * {WORDS} and n_words >= 15 and n_numbers < 0.3 * {WORDS}"),
]
N_VOTES = len(VOTES)
START = 0.9  # accuracy before anything is learned


def vote_mask() -> Column:
    mask = F.lit(0)
    for j, (_, _, cond) in enumerate(VOTES):
        mask = mask + F.when(F.expr(cond), F.lit(1 << j)).otherwise(F.lit(0))
    return mask.alias("votes")


#: Class balance of the posteriors; a text on which all functions abstain is prose. It stays as it is: learned along with the
#: accuracies, it drifts to one kind, since the functions abstain on most texts of the rarer ones.
BALANCE = np.array([0.4, 0.2, 0.2, 0.2])


def fit_votes(counts: dict[int, int], rounds: int = 50) -> np.ndarray:
    """Accuracy of every labelling function, by expectation-maximization over the vote patterns.

    A function that fires names its kind with its accuracy and the other kinds alike with the rest; abstaining says
    nothing. The expectation is the posterior kind of each pattern, the maximization the mean posterior of the named
    kind over the texts a function fired on, with a few pseudo-counts at the starting accuracy.
    """
    own = np.array([KINDS.index(k) for _, k, _ in VOTES])
    masks = np.array(sorted(counts), np.int64)
    n = np.array([counts[m] for m in masks], np.float64)
    fired = (masks[:, None] >> np.arange(N_VOTES)) & 1
    accuracy = np.full(N_VOTES, START)
    for _ in range(rounds):
        post = posteriors(fired, accuracy)
        right = (fired * n[:, None] * post[:, own]).sum(0)
        accuracy = np.clip((right + 20 * START) / ((fired * n[:, None]).sum(0) + 20), 0.7, 0.995)
    return accuracy


def posteriors(fired: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    log = np.tile(np.log(BALANCE), (len(fired), 1))
    for j, (_, kind, _) in enumerate(VOTES):
        per = np.full(len(KINDS), np.log((1 - accuracy[j]) / (len(KINDS) - 1)))
        per[KINDS.index(kind)] = np.log(accuracy[j])
        log += fired[:, j : j + 1] * per
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def typed(df: DataFrame, common: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Statistics, the votes, ``kind`` and ``kind_prob`` of a table with a column ``text``, which is not carried on.

    The statistics are computed once and written to the shared folder; with ``keep`` only those columns stay.
    The pattern counts come from one pass over all rows of ``df``; posteriors return as a map of at most
    ``2 ** N_VOTES`` entries (only those patterns that occur).
    """
    st = measured(df, common).withColumn("votes", vote_mask())
    st = written(st if keep is None else st.select(*keep, "n_chars", "votes"), "textstats")
    counts = {r.votes: r["count"] for r in st.where("n_chars > 0").groupBy("votes").count().collect()}
    if not counts:
        return st.withColumn("kind", F.lit(None).cast("string")).withColumn("kind_prob", F.lit(None).cast("double"))
    accuracy = fit_votes(counts)
    masks = sorted(counts)
    fired = (np.array(masks, np.int64)[:, None] >> np.arange(N_VOTES)) & 1
    post = posteriors(fired, accuracy)
    rows = [(int(m), KINDS[int(p.argmax())], round(float(p.max()), 6)) for m, p in zip(masks, post)]
    known = df.sparkSession.createDataFrame(rows, "votes int, kind string, kind_prob double")
    return st.join(F.broadcast(known), "votes", "left")


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks labelled Text with at least 80 characters."""
    b = table(spark, sf_dir, "blocks").select("block_id", "label", "text")
    return b.where((F.lower(F.trim("label")) == "text") & (F.length("text") >= 80) & F.col("block_id").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed(text_blocks(spark, sf_dir), keep=["block_id"])
    return t.where("kind <> 'prose'").select("block_id", "kind").distinct()


def _common(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted({r.word.lower() for r in table(spark, sf_dir, "common_words").select("word").distinct().collect() if r.word})


def _reported(t: DataFrame, id_col: str) -> DataFrame:
    """The reported statistics, all of them measured on every text."""
    c = F.col
    return t.select(
        id_col, "n_words",
        F.round(ratio(c("n_chars") - c("n_spaces"), c("n_words")), 6).alias("mean_word_len"),
        F.round(ratio(c("n_chars") - c("n_letters") - c("n_digits") - c("n_spaces"), c("n_chars")), 6).alias("symbol_ratio"),
        F.round(ratio(c("n_line_ends"), c("n_lines")), 6).alias("line_end_share"),
        F.round(ratio(c("n_common"), c("n_words")), 6).alias("common_share"),
        "kind", "kind_prob",
    )


def p3_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every document."""
    return _reported(typed(table(spark, sf_dir, "documents").select("doc_id", "text"), _common(spark, sf_dir)), "doc_id")


def p3_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every block, whatever its label and length."""
    b = table(spark, sf_dir, "blocks").select("block_id", "text").where("block_id is not null").distinct()
    return _reported(typed(b, _common(spark, sf_dir)), "block_id")


def p3_document_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document alone."""
    m = measured(table(spark, sf_dir, "documents").select("doc_id", "text"), _common(spark, sf_dir))
    return m.select("doc_id", "n_chars", "n_words", "n_lines", "n_letters", "n_digits", "n_spaces", "n_line_ends", "n_common", "n_pipes", "n_moji")


_SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def oracle_sql() -> dict[str, str]:
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    return {
        "p3_document_measures": rf"""with d as (select doc_id, coalesce(text, '') as t from documents), c as (select list(distinct lower(word)) as ws from common_words where word is not null)
select doc_id, length(t)::bigint as n_chars, {count(f'[^{_SPACE[1:-1]}]+'.replace("[^", "[^"))}::bigint as n_words, len(string_split(t, chr(10)))::bigint as n_lines, {count(r'[\p{L}\p{M}]')}::bigint as n_letters, {count(r'\p{Nd}')}::bigint as n_digits,
 ({count('[ \\n]')})::bigint as n_spaces, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[.!?。！？।؟…][»”"’)]?{_SPACE}*$')))::bigint as n_line_ends,
 len(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}’'']+'), lambda w: list_contains(ws, w)))::bigint as n_common, {count('[|]')}::bigint as n_pipes, {count('[ÐÑÃÂ�□■]')}::bigint as n_moji from d, c""",
    }
