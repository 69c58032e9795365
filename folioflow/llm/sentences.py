"""Problem 4: sentence boundaries by a finite transducer, composed chunk by chunk with a parallel prefix scan.

Tokens of a text are reduced to a small alphabet of classes. A deterministic transducer reads the classes and emits a
boundary when the token just read proves that the previous sentence is over. A stretch of tokens is a function from
states to states; the functions of equal chunks are computed side by side for all states, composed by a logarithmic
scan, and only then each chunk is replayed from its now known first state. A long document is therefore cut into many
chunks that cost no more than those of short ones, and no text is truncated.

Null or empty texts have no sentences. A text without any end mark is one sentence. Repeated rows are the caller's
affair: each input row gives its own sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, table

CHUNK = 64

#: Abbreviations that are followed by what they abbreviate, so their full stop ends nothing.
NEVER_FINAL = frozenset(
    """dr mr mrs ms prof st no nos fig figs sec secs vol vols approx cf vs ca inv tab abb abschn nr vgl bzw str rd av ave
    sr sra dra dña srta secc núm pág págs art cap avda tel tél tf mme mlle bd chap sect tabl janv févr avr juil env réf
    рис табл разд гл стр см ср ок тел ул пер пр просп пл наб им проф доц акад инв корп кв вул буд бул просп див пор розд
    мал янв февр мар апр авг сент окт нояб дек січ лют бер квіт трав черв лип серп вер жовт лист груд
    ene feb abr jul ago sept oct nov dic jan aug dec jr eds ed pp p с okt dez mär sep""".split()
)
#: Abbreviations that may stand last in a sentence.
MAY_END = frozenset("etc usw ff f д п др пр т е i e g m h a руб тыс коп грн млн uhr jh".split())
#: Months after a German ordinal number.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

RESET, LOW, UP, ABN, ABF, INI, NUM, NUMD, YEAR, MON, DOT, STRONG, CJKT, CLOSE, OPEN, SPACE, DASH, CASELESS, OTHER, QUOTATIVE, THAI, PARA, CAPS, NUML = range(24)
N_CLASSES = 24

TOKEN = re.compile(
    r"(?P<para>[ \t]*\n[ \t]*\n\s*)|(?P<space>\s+)"
    r"|(?P<num>\d+(?:[.,:/\-]\d+)*(?![^\W_]))"
    r"|(?P<thai>[฀-๿]+)"
    r"|(?P<quot>(?<=[”」』’])(?:と|って|然|说|問|问|道|便|就|随))"
    r"|(?P<caseless>[\u0600-\u060b\u060d-\u061a\u061c-\u061e\u0620-\u06d3\u06d5-\u06ff\u0900-\u0963\u0966-\u097f぀-ヿ㐀-鿿가-힯]+)"
    r"|(?P<word>[^\W_](?:[\ẁ-ͯ​-‍⁠�\xad'’]|!(?=[a-zа-яёіїєßà-ÿ]))*)"
    r"|(?P<strong>…|\.{2,}|[!?؟]+[.!?]*)|(?P<dot>[.．])|(?P<cjk>[。！？｡।॥۔]+)"
    r"|(?P<close>[)\]}»”」』’›]|(?<=[^\s(\[«„])[\"“'])|(?P<open>[(\[{«„“‘\"「『‹'¿¡])"
    r"|(?P<dash>[-—–‐‑])|(?P<other>.)",
    re.S,
)
KIND = {"para": PARA, "space": SPACE, "thai": THAI, "quot": QUOTATIVE, "caseless": CASELESS, "strong": STRONG, "dot": DOT, "cjk": CJKT, "close": CLOSE, "open": OPEN, "dash": DASH, "other": OTHER}
GROUPS = {i: KIND.get(name, name) for name, i in TOKEN.groupindex.items()}
STREET = re.compile(r"(?:str|pl)$")


@lru_cache(maxsize=100_000)
def word_class(word: str) -> int:
    low = word.lower()
    if low in ("º", "ª", "°"):
        return LOW
    if low in ("г", "р"):
        return YEAR if word == low else INI
    if low in MONTHS and word != low:
        return MON
    if low in NEVER_FINAL:
        return ABN
    if low in MAY_END:
        return INI if word != low and len(word) == 1 else ABF
    if len(word) == 1 and word != low:
        return INI
    if len(word) > 5 and STREET.search(low):
        return ABN
    first = word[0]
    if len(word) > 1 and word.isupper():
        return CAPS
    if first != first.lower() or (word != low and len(word) <= 3) or unicodedata.category(first) in ("Lt",):
        return UP
    if word != low and any(c.isupper() for c in word[1:3]):
        return UP
    if not first.isdigit() and first == first.upper():
        return CASELESS
    return LOW


def tokens(text: str) -> tuple[list[int], list[int]]:
    """Class and end position of every token."""
    classes, ends = [], []
    for m in TOKEN.finditer(text):
        kind = GROUPS[m.lastindex]
        end = m.end()
        if kind == "word":
            kind = word_class(m.group())
        elif kind == "num":
            size = end - m.start()
            kind = NUML if size > 2 else NUMD if text[end : end + 1] == "." else NUM
        classes.append(kind)
        ends.append(end)
    return classes, ends


# ---------------------------------------------------------------------------------------------------------------------
# The transducer. A state says what the last word was, or which kind of end mark is waiting for proof.

STATES = [
    "start", "body", "low", "abn", "abf", "ini", "num", "date", "thai", "thai_sp",
    *(f"{kind}{form}" for kind in ("plain", "never", "may", "number", "date_dot", "strong") for form in ("", "_closed", "_spaced")),
    "cjk", "cjk_closed",
]
STATE = {name: i for i, name in enumerate(STATES)}
AFTER_WORD = {LOW: "low", UP: "body", ABN: "abn", ABF: "abf", INI: "ini", NUM: "num", NUMD: "num", NUML: "num", CAPS: "body", MON: "body", YEAR: "abn", CASELESS: "body", QUOTATIVE: "body", THAI: "thai", OTHER: "body", DASH: "body", OPEN: "body", CLOSE: "body"}
DOT_AFTER = {"body": "plain", "low": "plain", "abn": "never", "abf": "may", "ini": "never", "num": "number", "date": "date_dot", "thai": "plain", "thai_sp": "plain"}
STARTERS = {UP, CAPS, NUML, OPEN, CASELESS, INI, MON, THAI, NUM, NUMD, QUOTATIVE}


def step(state: str, cls: int) -> tuple[str, bool]:
    """Next state, and whether a sentence ended before this token."""
    if cls in (RESET, PARA):
        return "start", state != "start"
    if state == "start":
        if cls == SPACE:
            return "start", False
        return {DOT: "body", STRONG: "strong", CJKT: "cjk"}.get(cls) or AFTER_WORD[cls], False
    if state in ("cjk", "cjk_closed"):
        if cls == SPACE:
            return state, False
        if cls == CLOSE:
            return "cjk_closed", False
        if cls in (CJKT, STRONG, DOT):
            return "cjk", False
        if state == "cjk_closed" and cls in (QUOTATIVE, OTHER, LOW):
            return "body", False
        return AFTER_WORD[cls], cls not in (OTHER, DASH)
    if state in ("thai", "thai_sp"):
        if cls == SPACE:
            return "thai_sp", False
        if cls == THAI:
            return "thai", state == "thai_sp"
    base, _, form = state.partition("_")
    if state.startswith("date_dot"):
        base, form = "date_dot", state[9:]
    if base in ("plain", "never", "may", "number", "date_dot", "strong"):
        if cls == SPACE:
            return base + "_spaced", False
        if cls == CLOSE:
            return base + "_closed", False
        if cls in (DOT, STRONG):
            return "strong", False
        if cls == CJKT:
            return "cjk", False
        after = AFTER_WORD[cls]
        if base == "date_dot" or base == "number" and cls == NUMD:
            after = "date" if cls in (NUM, NUMD, NUML) else after
        if form == "":  # nothing between the mark and this token
            ends = cls in (UP, INI) and base in ("plain", "number", "strong") or cls == CASELESS and base in ("plain", "strong")
        elif base == "plain":
            ends = cls in STARTERS or cls == ABN
            ends = ends and cls != ABN
        elif base == "strong":
            ends = cls in STARTERS and not (form == "closed")
        elif base == "may":
            ends = cls in (UP, CAPS, OPEN, CASELESS, INI, MON, THAI, NUML)
        elif base == "number":
            ends = cls in (UP, CAPS, OPEN, CASELESS, INI, THAI, NUM, NUML)
        else:
            ends = False
        return after, ends
    # ordinary body states
    if cls == SPACE:
        return state, False
    if cls == DOT:
        return DOT_AFTER.get(state, "plain"), False
    if cls == STRONG:
        return "strong", False
    if cls == CJKT:
        return "cjk", False
    if cls == YEAR:
        return ("abf" if state == "num" else "abn"), False
    return AFTER_WORD[cls], False


def _compile() -> tuple[np.ndarray, np.ndarray]:
    delta = np.zeros((len(STATES), N_CLASSES), np.uint8)
    emit = np.zeros((len(STATES), N_CLASSES), bool)
    for i, s in enumerate(STATES):
        for c in range(N_CLASSES):
            new, e = step(s, c)
            delta[i, c], emit[i, c] = STATE[new], e
    return delta, emit


DELTA, EMIT = _compile()


def run_transducer(classes: np.ndarray) -> np.ndarray:
    """True where a sentence ends before the token. Chunks are composed by a prefix scan over state functions."""
    n = len(classes)
    m = -(-n // CHUNK)
    padded = np.full(m * CHUNK, SPACE, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(m, CHUNK)
    flat = DELTA.reshape(-1)
    func = np.tile(np.arange(len(STATES), dtype=np.int64), (m, 1))  # the function of each chunk, for all states at once
    for j in range(CHUNK):
        func = flat[func * N_CLASSES + grid[:, j : j + 1]].astype(np.int64)
    gap = 1
    while gap < m:  # inclusive scan: func[i] becomes the function of chunks 0..i
        func[gap:] = np.take_along_axis(func[gap:], func[:-gap], axis=1)
        gap *= 2
    state = np.concatenate([[STATE["start"]], func[:-1, STATE["start"]]]).astype(np.int64)
    out = np.zeros((m, CHUNK), bool)
    flat_emit = EMIT.reshape(-1)
    for j in range(CHUNK):
        at = state * N_CLASSES + grid[:, j]
        out[:, j] = flat_emit[at]
        state = flat[at].astype(np.int64)
    return out.reshape(-1)[:n]


def split_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and end of every sentence of the texts."""
    classes: list[int] = []
    ends: list[int] = []
    rows: list[int] = []
    for i, t in enumerate(texts):
        if t:
            c, e = tokens(t)
            classes += c
            ends += e
            classes.append(RESET)
            ends.append(len(t))
            rows += [i] * (len(c) + 1)
    if not classes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls, end, row = np.array(classes, np.uint8), np.array(ends, np.int64), np.array(rows, np.int64)
    hit = np.flatnonzero(run_transducer(cls))
    solid = (cls != SPACE) & (cls != PARA) & (cls != RESET)
    last = np.maximum.accumulate(np.where(solid, np.arange(len(cls)), -1))
    before = last[hit - 1]
    s_row, s_end = row[hit], end[before]
    first_of_row = np.concatenate([[True], s_row[1:] != s_row[:-1]])
    s_start = np.where(first_of_row, 0, np.concatenate([[0], s_end[:-1]]))
    keep = s_end > s_start
    return s_row[keep], s_start[keep], s_end[keep]


def sentence_spans(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row (id, sentence_no, start_char, end_char) per sentence; the start includes the space before the sentence."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end = split_texts(b.column(1).to_pylist())
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
            number = np.arange(len(row)) - begin
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                names=[id_col, "sentence_no", "start_char", "end_char"],
            )

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(spans, f"`{id_col}` {kind}, sentence_no int, start_char int, end_char int")


def task_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks named in ``sentence_tasks``, each once. The task ids are broadcast only when few enough."""
    tasks = table(spark, sf_dir, "sentence_tasks").select("block_id").where("block_id is not null").distinct()
    n = table(spark, sf_dir, "sentence_tasks").count()
    blocks = table(spark, sf_dir, "blocks").select("block_id", "text").where("text is not null")
    return blocks.join(broadcast_if_small(tasks, n, 2_000_000), "block_id", "left_semi").dropDuplicates(["block_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans(task_blocks(spark, sf_dir), "block_id").select("block_id", "end_char").distinct()


def p4_document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence count and mean length of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = sentence_spans(docs, "doc_id")
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg(F.col("end_char") - F.col("start_char")), 3).alias("mean_chars"))
