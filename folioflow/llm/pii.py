"""Problem 2: personal data in free text by a semi-Markov conditional random field.

A text is segmented into entities and the rest. Candidate segments (at most ``MAX_ENTITY`` characters) come from open
patterns of each type: every number of five figures or more and every capitalised run, with all their parts within bounds,
street forms, and, in scripts without case, words beside a form of address; overlapping ones with different boundaries and
types compete. Lists of names, titles and cues and the vocabulary of a public tokenizer are features, never conditions. Each candidate is scored by
features of the whole span and of the words around it; a dynamic program over the boundaries picks the segmentation of
greatest score, so boundaries and types are chosen jointly. The rest of the text scores zero. Weights are learned by
gradient ascent on the conditional likelihood (forward-backward over the same segmentations) from sentences generated
here, about everyday matters, with entities and with look-alikes that are no personal data (orders, parts, headings,
dates); they are learned once on the driver and shipped as a small table.

Null and empty texts have no data and stay as they are. Repeated rows give equal results and count once in the queries.
Texts are read whole; the cost is linear in their length.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
MAX_ENTITY = 160


@dataclass(frozen=True)
class Params:
    sentences: int = 6000
    epochs: int = 6
    rate: float = 0.2
    decay: float = 1e-4
    seed: int = 5
    lexicon: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # public vocabulary that tells common words from names; may be absent


# Signs of other width and spaces of other kinds, one for one, so that positions stay those of the stored text.
PLAIN = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)} | dict.fromkeys([0xA0, 0x2002, 0x2009, 0x202F, 0x3000, 0x0A, 0x09, 0x0D], 0x20)
PLAIN_FROM = re.compile("[" + "".join(map(chr, PLAIN)) + "]")
_U, _L = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶŁĹĻĽŃŅŇŌŐŒŘŚŞŠŢŤŪŮŰŲŹŻŽȘȚА-ЯЁІЇЄҐΑ-Ω", "a-zß-öø-ÿāăąćčďđēėęěğģīįıķłĺļľńņňōőœřśşšţťūůűųźżžșțа-яёіїєґα-ωά-ώ"
_IN = rf"[{_L}’'̀-ͯ​-‍⁠﻿�!0-9{_U}]"
_W = rf"[{_U}]{_IN}+(?:[\xad¬‐-] ?{_IN}+)*"
#: Small words inside names.
PARTICLES = "de|da|do|dos|del|della|di|du|van|von|ter|ten|bin|ibn|al|el|af|av"
_AFTER = "der|den|de|la|las|los"  # a second one
_TOKEN = rf"(?:[{_U}]\.(?: ?[{_U}]\.)?|[{_U}](?:[{_L}’'̀-ͯ​-‍⁠﻿�]|!(?=\w))+(?:[{_U}][{_L}’]+)?(?:[\xad¬‐] ?[{_L}]+)*(?:-{_W})?|[{_U}][’'][{_U}]{_IN}+|[{_U}]{{2,}}(?:-[{_U}]{{2,}})?)"
RUN = re.compile(rf"(?<![\w@]){_TOKEN}(?:(?: {{1,2}}(?:{PARTICLES})(?: (?:{_AFTER}))?)? {{1,2}}{_TOKEN})*")
TOKEN = re.compile(rf"[{_U}]\.(?: ?[{_U}]\.)?|[^ ]+(?:(?<=[\xad¬‐]) [^ ]+)*")
_DOT = r"(?:\.| ?[\[(]dot[\])] ?)"
_LABEL = r"[A-Za-z0-9_+]+(?:- ?[A-Za-z0-9_+]+)*"
EMAIL = re.compile(rf"(?<![\w.])[A-Za-z0-9_+\-]+(?:{_DOT}[A-Za-z0-9_+\-]+)*(?: ?@ ?| ?[\[(]at[\])] ?){_LABEL}(?:{_DOT}{_LABEL})+")
NUMBER = re.compile(r"(?<![\w.,/№@-])(?:[(+]{0,2}\d+\)?(?:(?: № | ?\(|\) ?|[ .\-/]{1,2})\d+\)?)*(?:[- ]?[A-Z](?!\w))?|[A-Z]{1,3}[ -]?\d[\dA-Z]*(?:[ -]\d+)*(?: [A-Z](?!\w))?|\d{1,3}[A-Z]{1,2}\d{4,})(?![\w@])")
GROUP = re.compile(r"[(+]{0,2}[A-Z]*\d[\dA-Z]*\)?")
ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
FIGURE = re.compile(r"\d")
MAX_GROUPS = 8  # groups of a number that may be one datum
_N = rf"{_W}"
#: Words of street names, by where they stand: behind the name, at its end, before it.
_BEHIND = r"Street|Lane|Road|Avenue|Drive|Square|Court|Rd|Ave|St|Way|Crescent|Close|Place|Terrace|Boulevard|Blvd|Row|Hill|Gardens|Grove|Mews|Walk|Parkway|Highway|Hwy|Ln|Dr|Ct|Pl"
_AT_END = r"str\.|straße|strasse|weg|platz|allee|gasse|ring|damm|ufer|steig|markt|graben|gatan|vägen|straat|laan|kade|plein|utca|gade|vej|katu|tie"
_AT = r"Am|An der|Im|Zum|Zur|Auf der|An den|Unter den|In der"
_FR = r"rue|avenue|av\.|boulevard|bd|allée|place|chemin|impasse|quai|cours|route|square|passage|villa|sentier"
_ES = r"C/|Calle|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía|Carrera|Rua|Praça|Via|Viale|Piazza|Corso|Largo"
_RU = r"ул|вул|пер|пров|пр|просп|пр-т|наб|пл|бул|бульв|шоссе|ш|проезд|улица|вулиця|переулок|проспект|набережная"
#: Name, what every match of the pattern holds (none where the pattern opens with fixed words itself), pattern.
ADDRESS = [
    ("en", re.compile(rf" (?:{_BEHIND})\b"), re.compile(rf"(?:{_N} House, )?\d{{1,5}}[A-Za-z]? {_N}(?: {_N})? (?:{_BEHIND})\b\.?(?:, (?:Flat|Apt\.?|Unit|Suite) \d+[A-Z]?)?(?:, {_N}(?: {_N})?(?:,? [A-Z]{{2}})?(?: \d{{5}})?)?")),
    ("box", None, re.compile(rf"P\. ?O\. ?Box \d+(?:, {_N}(?: \d{{5}})?)?")),
    ("de", re.compile(rf"(?:{_AT_END}) \d|(?:{_AT}) [{_U}]"), re.compile(rf"(?<![\w-])(?:{_N}(?:{_AT_END})|[{_U}]{_IN}*(?:- ?| )(?:[Ss]tr\.|[Ss]traße|[Ww]eg|[Pp]latz|[Aa]llee)|(?:{_AT}) {_N}(?: (?:Tor|Platz|Weg|Markt|Ufer|Ring))?) \d{{1,4}}[a-z]?(?!\d)(?:, \d{{4,5}}(?: [A-Z]{{2}})? {_N}|, {_N})?")),
    ("es", None, re.compile(rf"(?<!\w)(?:{_ES})(?: d[aeo]s?(?: la| los| las)?| del)? {_N}(?: {_N})?,? (?:n\.º |nº |n° )?\d{{1,4}}(?:, \d{{1,2}}\.º [A-Z])?(?:, \d{{4,5}} {_N}|, {_N})?")),
    ("fr", re.compile(rf" (?:{_FR})"), re.compile(rf"(?<![\d.])\d{{1,4}}(?: bis| ter)?,? (?:{_FR})(?: de la| de| des| du| d’| d')? ?{_N}(?: {_N})?(?:, \d{{5}} {_N}(?:- ?{_IN}+)*|, {_N})?")),
    ("ru", re.compile(rf"(?:{_RU})\.? "), re.compile(rf"(?<![\w])(?:\d{{5,6}}, )?(?:(?:г|м|с|пос|смт)\. {_N}, )?(?:{_RU})\.? {_N}(?: {_N})?(?:, (?:д\.|дом|буд\.|будинок)? ?\d+[а-я]?)(?:, (?:кв|корп|оф|стр)\. ?\d+)*")),
    # a number and a name, or a name and a number, with a place behind: no word for a street is needed
    ("num", re.compile(r"\d"), re.compile(rf"(?<![\w.,/-])\d{{1,4}}[A-Za-z]? {_N}(?: {_N}){{0,2}}, (?:{_N}(?: \d{{4,6}})?|\d{{4,6}} {_N})")),
    ("name", re.compile(r"\d"), re.compile(rf"(?<![\w-]){_N}(?: {_N})? \d{{1,4}}[a-z]?, \d{{4,6}} {_N}(?: {_N})?")),
]
#: Common given names (a feature, not a condition).
GIVEN = frozenset(
    """anna maria peter paul john james mary robert linda emma oliver alice henry clara george david sarah michael laura thomas susan daniel karen mark
    hans klaus karl monika jürgen sabine uwe jean pierre marie luc claire julien carlos ana josé carmen pablo elena lucía
    иван анна мария пётр ольга павел сергей елена наталья дмитрий алексей татьяна тарас оксана андрій микола богдан софія
    mohammed fatima ahmed ali omar wei li yuki hiroshi raj priya amit sven lars ingrid giulia marco paulo joão piotr katarzyna""".split()
)
#: Function words that a sentence or a note opens with.
NO_NAME = frozenset(
    """der die das ein eine einen jede jeder im in am an auf the a an this our each every for on at el la los las un una le les ce cette per que und and y et or nach vor mit bei von aus dem den des zu
    as if it he she we they his her by to from with when where what who how no not но и в на по из за от до для при после не как он она это если что кто мы та і й у з до від за цей ця
    selon según nach laut wer was wo sie er es ist sind war please dear bitte sehr caro chère cher estimado""".split()
)
#: Titles and forms of address before a name.
TITLES = frozenset("dr dra prof mr mrs ms miss sir madam sr sra srta don doña m mme mlle herr frau доц проф др г-н г-жа господин госпожа пан пані тов гр inż ing dipl rev capt lt sgt sig signor signora dott".split())
PATRONYMIC = re.compile(r"(?:ович|евич|ич|овна|евна|ична|івна|ївна|йович)$")
SURNAME = re.compile(r"(?:ов|ова|ев|ева|ин|ина|ский|ская|ской|цкий|енко|чук|ук|ко|ів|ський|ська|son|sen|mann|berg|stein|ski|ska|wicz|ez|oglu|vić|escu|ström|qvist|opoulos|yan|dze|eau|etti|ini)$")
#: Cues of the kind of a number, of codes that are no personal data last.
CUES = [
    ("phone", re.compile(r"(?i)\b(?:phone|tel[eé]?(?:ph|f)on\w*|tel|tél\w*|call|dial|ring|fon|mobil\w*|cell|fax|whatsapp|sms|handy|rufnummer|portable|móvil|llam\w+|тел\w*|моб\w*|звон\w*|дзвон\w*|viber)\b|电话|手机|電話|フォン|फ़ोन|मोबाइल|هاتف|جوال|โทร|เบอร์")),
    ("id", re.compile(r"(?i)\b(?:passport\w*|паспорт\w*|ausweis\w*|personalausweis\w*|reisepass\w*|identi\w+|id|ssn|social security|licen[cs]e|снилс|инн|рнокпп|dni|nif|nie|cpf|carte|documento|pièce|séjour|ausländer\w*|steuer\w*|tax|tin|national\w*|insurance|versicher\w*|aadhaar|pesel|personnummer|iban|удостоверени\w*|посвідченн\w*|pasaporte|passeport|permis|führerschein\w*|права)\b|身份证|护照|パスポート|マイナンバー|आधार|पासपोर्ट|جواز|هوية|บัตรประชาชน|พาสปอร์ต")),
    ("code", re.compile(r"(?i)\b(?:shelf|mark|signatur\w*|cote|шифр\w*|inventory|inventar\w*|инвентарн\w*|інвентарн\w*|numéro|version\w*|верси\w*|form|vordruck|бланк|isbn|issn|doi|invoice|order|rechnung\w*|facture|factura|pedido|commande|bestell\w*|заказ\w*|счёт\w*|рахун\w*|артикул\w*|batch|serial|model|part|item|sku|lot|tracking|ticket|case|file|ref\w*|akte\w*|aktenzeichen|expediente|signatura|catalog\w*|катал\w*|page|seite|стр|page|year|date)\b")),
]
_HAN = "㐀-鿿"
#: Frequent family names of one character, forms of address, and words before a name, in scripts without case.
HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
UNCASED = [
    ("zh", re.compile(rf"(?:(?<=姓名:)|(?<=联系人:)|(?<=作者:)|(?<=患者)|(?<=申请人)|(?<=同事)|(?<=客户)|(?<=学生)|(?<=医生)|(?<=老师)|(?<=经理)|(?<=由)|(?<=[,。、“]))[{HAN_FAMILY}][{_HAN}]{{1,2}}|[{HAN_FAMILY}][{_HAN}]{{1,2}}(?=先生|女士|小姐|教授|医生|老师|经理|同学|博士)")),
    ("ja", re.compile(rf"[{_HAN}]{{1,3}}[ 　]?[{_HAN}ぁ-んァ-ヶ]{{1,4}}(?=さん|様|氏|先生|教授|君)|(?<=氏名:)[{_HAN}]{{1,3}}[ 　]?[{_HAN}ぁ-んァ-ヶ]{{1,4}}|[ァ-ヶー]{{2,}}・[ァ-ヶー]{{2,}}")),
    ("ar", re.compile(r"(?:(?<=السيد )|(?<=السيدة )|(?<=الدكتور )|(?<=الدكتورة )|(?<=الأستاذ )|(?<=الأستاذة )|(?<=الاسم: )|(?<=المريض )|(?<=الموظف ))[ء-ي]+(?: (?:بن |بنت |عبد )?[ء-ي]+){0,2}")),
    ("hi", re.compile(r"(?:(?<=श्री )|(?<=श्रीमती )|(?<=सुश्री )|(?<=डॉ. )|(?<=डॉ॰ )|(?<=प्रो. )|(?<=नाम: )|(?<=कुमारी ))[ऀ-ॣ]+(?: [ऀ-ॣ]+){0,2}|[ऀ-ॣ]+(?: [ऀ-ॣ]+)?(?= जी[ ,।])")),
    ("th", re.compile(r"(?:(?<=นาย)|(?<=นางสาว)|(?<=คุณ)|(?<=ดร\.)|(?<=ดร\. )|(?<=ชื่อ ))[ก-๎]{2,}(?: [ก-๎]{2,})?(?=[ ,.]|$)")),
]
HAS_UNCASED = re.compile("[ء-ॣก-๎ァ-ヶ㐀-鿿]")


_LEXICONS: dict[str, frozenset[bytes]] = {}


def lexicon(path: str) -> frozenset[bytes]:
    """Entries of a public tokenizer's vocabulary: words that it holds whole are common ones. Empty when there is no file."""
    if path not in _LEXICONS:
        import base64
        from pathlib import Path

        f = Path(path)
        _LEXICONS[path] = frozenset(base64.b64decode(x.split()[0]) for x in f.read_bytes().splitlines()) if f.is_file() else frozenset()
    return _LEXICONS[path]


def use_lexicon(path: str, words: frozenset[bytes]) -> None:
    """On a worker: the entries that the driver learned with, whether or not the file is there."""
    _LEXICONS[path] = words


def _shape(s: str) -> str:
    out = []
    for c in s:
        k = "9" if c.isdigit() else "A" if c.isalpha() else c
        if not out or out[-1] != k or k not in "9A":
            out.append(k)
    return "".join(out)


def _digits(s: str) -> str:
    """Group lengths of a number."""
    return "-".join(str(len(x)) for x in re.findall(r"\d+", s))


_WORD = re.compile(r"[^\W_]+")
_NEXT = re.compile(r" ?([(·,:;.|/]|[^\W_]+)")


def _around(t: str, start: int, end: int) -> list[str]:
    before = t[max(0, start - 34) : start]
    ws = _WORD.findall(before.lower())
    last = before.rstrip()[-1:]
    m = _NEXT.match(t, end)
    after = m.group(1).lower() if m else ""
    b1 = ws[-1] if ws else ""
    return [
        f"b1={'9' if b1[:1].isdigit() else b1}", f"bc={last if last and not last.isalnum() else 'w' if last else '^'}",
        f"a1={after if len(after) < 2 or after.isalpha() else '9'}", f"t={b1 in TITLES and (len(b1) > 1 or before.rstrip().endswith('M.'))}",
    ]


def _cue(t: str, start: int) -> str:
    """The kind that the nearest cue word before a number names."""
    before = t[max(0, start - 34) : start]
    best, at = "none", -1
    for name, pattern in CUES:
        for m in pattern.finditer(before):
            if m.end() > at:
                best, at = name, m.end()
    return best


@lru_cache(maxsize=200_000)
def _name_token(w: str, path: str) -> tuple[str, tuple[str, ...]]:
    """Shape sign and features of one token of a name."""
    low = w.strip(".").lower()
    if w[1:2] == ".":
        return "I", ("ini",)
    if w == low:
        return "w", ("part",)
    lex = lexicon(path)
    low_known, cap_known = f" {low}".encode() in lex, f" {low[:1].upper()}{low[1:]}".encode() in lex
    kind = "stop" if low in NO_NAME else "title" if low in TITLES else "given" if low.split("-")[0] in GIVEN else "pat" if PATRONYMIC.search(low) else "sur" if SURNAME.search(low) else "lex" if low_known else "cap" if cap_known else "new"
    shape = "C" if w.isupper() and len(w) > 1 else "P" if kind == "pat" else "W"
    return shape, (kind, f"l{low_known:d}{cap_known:d}", f"s={low[-3:]}", f"p={low[:2]}")


Candidate = tuple[int, int, int, list[str]]  # start, end, kind, features


def _numbers(t: str, out: list[Candidate]) -> None:
    for m in ACCOUNT.finditer(t):
        out.append((m.start(), m.end(), 2, ["2", "2:account", f"2:cue={_cue(t, m.start())}"]))
    for m in NUMBER.finditer(t):
        base, s = m.start(), m.group()
        if len(s) < 5 or sum(c.isdigit() for c in s) < 5:
            continue
        gs = [(g.start(), g.end()) for g in GROUP.finditer(s)]
        gs[0] = (0, gs[0][1])
        starts = [k for k, (a, _) in enumerate(gs) if k == 0 or s[a] in "+(" and not s[a - 1 : a] == ")" or s[gs[k - 1][1] : a].strip() == "/" or s[a].isalpha()]
        for i in starts:
            a = base + gs[i][0]
            cue, ctx = _cue(t, a), _around(t, a, a)
            for j in range(i, min(len(gs), i + MAX_GROUPS)):
                b = base + (m.end() - base if j == len(gs) - 1 else gs[j][1])
                x = t[a:b]
                if x[-1] == ")" and x.count("(") < x.count(")"):
                    x, b = x[:-1], b - 1
                n = sum(c.isdigit() for c in x)
                if n < 5:
                    continue
                more = "end" if j == len(gs) - 1 else s[gs[j][1] : gs[j][1] + 1]
                nxt = _NEXT.match(t, b)
                shape, groups = _shape(x), _digits(x)
                feats = [f"shape={shape}", f"groups={groups}", f"n={min(n, 20)}", f"first={x[0] if not x[0].isdigit() and not x[0].isalpha() else x[0] if x[0] in '089' else '9' if x[0].isdigit() else 'A'}", f"letters={min(sum(c.isalpha() for c in x), 3)}", f"grp={j - i}", f"more={more}", f"left={i > 0}", f"cue={cue}", f"cue={cue},{groups}", f"a1={nxt.group(1).lower() if nxt and nxt.group(1).isalpha() else ''}", *ctx[:2]]
                for kind in (1, 2):
                    out.append((a, b, kind, [f"{kind}", *[f"{kind}:{f}" for f in feats]]))


def _names(t: str, path: str, out: list[Candidate]) -> None:
    for m in RUN.finditer(t):
        base, run = m.start(), m.group()
        if " " not in run and not t[max(0, base - 12) : base].rstrip(" .").rpartition(" ")[2].lower().lstrip("(«“\"") in TITLES:
            continue
        toks = [(x.start(), x.end(), x.group()) for x in TOKEN.finditer(run)]
        n = len(toks)
        if n == 1:  # one word alone is a name only beside a form of address
            w = toks[0][2]
            if w[1:2] == "." or len(w) < 2:
                continue
            ctx = _around(t, base, m.end())
            if ctx[3] == "t=False":
                continue
        info = [_name_token(w, path) for _, _, w in toks]
        for i in range(n):
            if info[i][0] == "w":
                continue
            for j in range(i, min(n, i + 6)):
                shape = "".join(x[0] for x in info[i : j + 1])
                words = len(shape.replace("w", ""))
                if info[j][0] == "w" or words > 4 or "W" not in shape and "C" not in shape and "P" not in shape:
                    continue
                title = i > 0 and "title" in info[i - 1][1] if i else False
                a, b = base + toks[i][0], base + toks[j][1]
                ctx = _around(t, a, b)
                if words == 1 and not (title or ctx[3] == "t=True"):
                    continue
                left = info[i - 1][1][0] if i else "-"
                right = info[j + 1][1][0] if j < n - 1 else "-"
                kinds = [x[1][0] for x in info[i : j + 1]]
                feats = ["N", f"N:shape={shape}", f"N:kinds={','.join(kinds)}", f"N:left={left}", f"N:right={right}", f"N:len={words}", f"N:ini={'I' in shape}", f"N:{'c' if 'Ѐ' <= toks[j][2][0] <= 'ӿ' else 'l'}:{shape}"]
                feats += [f"N:any={k}" for k in set(kinds)]
                feats += [f"N:0{f}" for f in info[i][1]] + [f"N:9{f}" for f in info[j][1]]
                out.append((a, b, 4, feats + [f"N:{f}" for f in ctx]))


def candidates(text: str, lex: str = "") -> list[Candidate]:
    """Every candidate segment with its features. ``lex``: path of a tokenizer's vocabulary, read as a list of common words."""
    t = text.translate(PLAIN) if PLAIN_FROM.search(text) else text
    figures = FIGURE.search(t) is not None
    out: list[Candidate] = []
    if "@" in t or "at]" in t or "at)" in t:
        for m in EMAIL.finditer(t):
            s = m.group()
            out.append((m.start(), m.end(), 0, ["E", f"E:at={'@' in s}", f"E:dots={min(3, s.count('.') + s.count('dot'))}"]))
    if figures:
        _numbers(t, out)
    for name, cue, pattern in ADDRESS if figures else ():  # every form of an address has a number
        if cue is None or cue.search(t):
            for m in pattern.finditer(t):
                a, b = m.span()
                if b - a > MAX_ENTITY:
                    continue
                s = m.group()
                feats = ["S", f"S:{name}", f"S:commas={min(3, s.count(','))}", f"S:five={bool(re.search(r'(?<!\d)\d{5,6}(?!\d)', s))}", f"S:first={s[0].isdigit()}", f"S:{name},{s[0].isdigit()},{s.count(',')}"]
                out.append((a, b, 3, feats + [f"S:{f}" for f in _around(t, a, b)[:3]]))
    _names(t, lex, out)
    if HAS_UNCASED.search(t):
        for name, pattern in UNCASED:
            for m in pattern.finditer(t):
                s = m.group()
                ends = [m.end()] if name in ("zh", "ja") else [m.start() + x.end() for x in re.finditer(r"\S+", s)]
                for b in ends:
                    out.append((m.start(), b, 4, ["U", f"U:{name}", f"U:len={min(b - m.start(), 12)}", f"U:{name},{t[m.start():b].count(' ')}", f"U:{name},a={t[b : b + 1]}"]))
    return out


# ---------------------------------------------------------------------------------------------------------------------
# Learning


def _segments(cands: list[Candidate], scores: list[float]) -> tuple[float, list[float]]:
    """Log partition over all sets of disjoint candidates, and each candidate's marginal."""
    points = sorted({0} | {c[0] for c in cands} | {c[1] for c in cands})
    at = {x: i for i, x in enumerate(points)}
    n = len(points)
    ends: list[list[int]] = [[] for _ in range(n)]
    starts: list[list[int]] = [[] for _ in range(n)]
    for k, c in enumerate(cands):
        ends[at[c[1]]].append(k)
        starts[at[c[0]]].append(k)

    def add(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    fwd = [0.0] * n
    for i in range(1, n):
        fwd[i] = fwd[i - 1]
        for k in ends[i]:
            fwd[i] = add(fwd[i], fwd[at[cands[k][0]]] + scores[k])
    bwd = [0.0] * n
    for i in range(n - 2, -1, -1):
        bwd[i] = bwd[i + 1]
        for k in starts[i]:
            bwd[i] = add(bwd[i], bwd[at[cands[k][1]]] + scores[k])
    z = fwd[-1]
    return z, [math.exp(fwd[at[c[0]]] + s + bwd[at[c[1]]] - z) for c, s in zip(cands, scores)]


def best_segmentation(cands: list[Candidate], scores: list[float]) -> list[int]:
    """Disjoint candidates of greatest total score."""
    order = sorted((k for k, s in enumerate(scores) if s > 0), key=lambda k: (cands[k][1], cands[k][0], cands[k][2]))
    best, take, picked = [0.0], [0], []
    ends = [0]
    import bisect

    for k in order:
        start = cands[k][0]
        j = bisect.bisect_right(ends, start, 1) - 1
        s = best[j] + scores[k]
        if s > best[-1]:
            best.append(s)
            take.append(j)
            picked.append(k)
        else:
            best.append(best[-1])
            take.append(-1)
            picked.append(k)
        ends.append(cands[k][1])
    out, i = [], len(best) - 1
    while i > 0:
        if take[i] < 0:
            i -= 1
        else:
            out.append(picked[i - 1])
            i = take[i]
    return out[::-1]


#: Family names, and nouns that stand in names of offices, products and headings, from which sentences are made.
FAMILY = """Smith Walker Hughes Okafor Novak Müller Schneider Krause Hoffmann Lefèvre Moreau Dubois García Romero Vargas Rossi Bianchi Silva Costa Kowalski Nowak Larsson Virtanen
Yılmaz Demir Khan Sharma Gupta Chen Tanaka Kim Nguyen O’Brien McDonald Cohen Haddad Diallo Mensah Petrescu Horváth Svoboda Jensen De Vries""".split()
FAMILY_C = "Смирнов Кузнецова Попов Волкова Соколовский Лебедева Козлов Новикова Морозов Павлова Зайцев Белая Шевченко Бондаренко Ткачук Кравчук Мельник Савченко Лисенко Гриценко".split()
GIVEN_L = """Anna Peter Mary Hans Claire Pablo Elena Karl Luc Carmen James Fatima Wei Raj Sven Giulia Paulo Katarzyna Omar Yuki Marco Thomas Laura Amit Ingrid Otto Zeno Mila Runa Bela Tomke Ilse Maud
Ethan Grace Jacob Victor Martha Rachel Simon Julia Adam Rose Patrick Helen Frank Alan Bruce Diana Eric Fiona Gordon Harriet Ian Jane Keith Lucy Martin Nancy Oscar Philip Ruth Stephen Teresa Ursula Vincent Walter
Andreas Birgit Dieter Friedrich Gisela Holger Jörg Lena Matthias Petra Rainer Stefan Ulrich Wolfgang Alain Brigitte Cécile Denis Élodie François Hélène Isabelle Jacques Laurent Mathilde Nicolas Pascale Quentin Sophie
Yves Alejandro Beatriz Cristina Diego Esteban Fernando Gloria Héctor Isabel Javier Lorena Manuel Natalia Pilar Ramón Sofía Agnes Basil Cyril Dora Felix Gwen Ivor Joan Leo Mabel Nigel Olive Percy Roy Sybil Theo""".split()
GIVEN_C = "Иван Анна Ольга Павел Сергей Елена Тарас Оксана Андрій Глеб Зоя Егор Дмитрий Мария Назар Лідія Ярослав Вера".split()
NOUNS = """Water Board City Library Harbour Hotel Annual Report Customer Service Human Resources Data Protection Road Works Night Shift Garden Centre Health Insurance Market Hall Public Transport Quarterly Review
Project Plan Summer School Power Station Building Permit Safety Rules Tax Office Train Station Press Release User Manual Table Contents Final Draft Chapter Summary Old Town North Bridge Evening Class""".split()
NOUNS_DE = "Versicherung Krankenhaus Rechnung Abteilung Kunde Vertrag Lieferung Werkstatt Bahnhof Zeitung Verwaltung Sitzung Beschluss Bericht Gebäude Prüfung Übersicht Aufgabe Leitung Schule Messung Auswahl Kasse".split()
PARTS_DE = ("Bau Haus Wasser Zeit Kunden Büro Schul Straßen Abend Garten Feuer Stadt Kraft Licht".split(), "plan amt stelle buch ordnung prüfung kasse drucker platte leser halter wert gerät wagen schein kreis teil messer blatt zeichen".split())
ADJ_DE = "Neue Alte Große Kleine Städtische Obere Untere Westliche Östliche Technische Freie".split()
NOUNS_C = "ОТЧЁТ ЗАЯВЛЕНИЕ СПИСОК ТОВАРОВ ПЛАН РАБОТ ПРАВИЛА БЕЗОПАСНОСТИ ГОДОВОЙ ОБЗОР РАСПИСАНИЕ ПОЕЗДОВ ДОГОВОР АРЕНДЫ ЗВІТ ПРО РОБОТУ УЧЁТ СВЕТОВЫХ ПРИБОРОВ НОВЫЕ СРЕДСТВА ПЕРЕВОЗКИ ВЫСОКОЕ НАПРЯЖЕНИЕ СЕТЕЙ".split()
ROLES_C = "Директор Инженер Бухгалтер Водитель Учитель Продавец Начальник Секретарь Тренер Адвокат Слесарь Редактор Лікар Вчитель Слюсар Адвокатка".split()
ROLES = "Manager Driver Teacher Engineer Director Nurse Coach Clerk Captain Officer Editor Plumber Lawyer Witness".split()


def _fill(r: random.Random) -> dict[str, str]:
    """Invented values for the slots of the sentences below."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    up = lambda n=1: "".join(r.choice("ABCDEFGHKLMNPQRSTXYZ") for _ in range(n))
    k = lambda n: str(r.randint(1, n))
    made = lambda: r.choice("Ba Ce Do Fa Gri Ha Ke Lo Mo Pe Ru So Ta Vo Wi Za Bre Chu Ene Oru Shi Tsi".split()) + "".join(r.choice("la ren mi to san der vi go nal tu ko be chi".split()) for _ in range(r.randint(0, 2))) + r.choice("berg ton mar dell wick son nier quez rov tel ska wu ndo esh lin ey".split())
    latin = lambda: made() if r.random() < 0.6 else r.choice(FAMILY)
    place = made
    made_c = lambda: r.choice("Ба Ве Гор Де Жи Ка Лу Ми Но Пет Ро Се Тро Фо Чер Ос Ша Юр".split()) + "".join(r.choice("ла ре ми то ва на ди ши".split()) for _ in range(r.randint(0, 2)))
    first = r.choice(GIVEN_L) if r.random() < 0.8 else made()
    first_c = r.choice(GIVEN_C) if r.random() < 0.8 else made_c() + r.choice("н й р".split())
    sur = made_c() + r.choice("ов ова ев ева ин ина ский ская енко".split()) if r.random() < 0.7 else r.choice(FAMILY_C)
    pat = r.choice("Иванович Петровна Сергеевич Ильинична Глебович Юрьевич Петрівна Андрійович Львовна Олегівна Максимович".split())
    i, j, j2 = up(), r.choice("АБВГДИКЛМНПРСТФ"), r.choice("АВГЮЛМСН")
    last = r.choice([latin(), latin(), latin(), latin() + "-" + latin(), latin().upper(), r.choice(["van ", "de ", "von ", "da "]) + latin()])
    name = r.choice([f"{first} {last}", f"{first} {last}", f"{first} {i}. {last}", f"{i}. {last}", f"{first} {r.choice(GIVEN_L)} {last}"])
    name_c = r.choice([f"{first_c} {sur}", f"{j}. {j2}. {sur}", f"{sur} {j}. {j2}.", f"{sur} {first_c} {pat}", f"{j}.{j2}. {sur}", f"{j}. {sur}", f"{first_c} {pat} {sur}"])
    box = made().lower()
    mail = r.choice([f"{box}@{made().lower()}.example", f"{i.lower()}.{box}@mail.{made().lower()}.net", f"{box}_{d(2)}@{made().lower()}-{made().lower()}.org", f"{box} (at) {made().lower()}.com", f"{box} [at] {made().lower()} [dot] org", f"{box}+x@{made().lower()}.test", f"{i}.{box.upper()}@{made().upper()}.ORG", f"{box}@ {made().lower()}.test"])
    phone = r.choice([f"+1{d(10)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"+49 (0){d(2)} {d(5)} {d(3)}", f"0049 {d(2)} {d(8)}", f"01{d(2)} {d(8)}", f"0{d(2)}/{d(5)}-{d(3)}", f"(0{d(2)}) {d(5)} {d(3)}", f"0{d(3)} {d(6)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33{d(3)} {d(6)}", f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", f"(+34) {d(3)} {d(2)} {d(2)} {d(2)}", f"{r.choice('679')}{d(2)}-{d(6)}", f"{r.choice('679')}{d(8)}", f"{r.choice('679')}{d(2)} {d(3)} {d(3)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+91 {d(5)} {d(5)}", f"+46 70 {d(3)} {d(2)} {d(2)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(3)}{d(9)}"])
    phone_c = r.choice([f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"8 {d(3)} {d(3)} {d(2)} {d(2)}", f"8-{d(3)}-{d(3)}-{d(2)}-{d(2)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+7{d(10)}", f"+380 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+380 {d(2)} {d(3)} {d(2)} {d(2)}", f"+380 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"+380{d(9)}", f"0{d(2)} {d(3)}-{d(2)}-{d(2)}"])
    ident = r.choice([f"{up()}{d(8)}", f"{up()}{d(7)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{up(2)} {d(2)} {d(2)} {d(2)} {up()}", f"{up(2)}{d(6)}{up()}", f"L{d(2)}X{d(2)}T{d(3)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(12)}", f"{d(2)}{up(2)}{d(5)}", f"{d(2)}.{d(3)}.{d(3)}-{up()}", f"{d(8)}{up()}", f"{d(8)}-{up()}", f"{up()}-{d(7)}-{up()}", f"{d(11)}", f"{d(9)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(6)}-{d(4)}", f"{up(2)}{d(7)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}"])
    iban = f"{r.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"
    ident_c = r.choice([f"{d(11)}", f"{d(3)}-{d(3)}-{d(3)} {d(2)}", f"{d(4)} № {d(6)}", f"{d(2)} {d(2)} {d(6)}", f"{d(4)} {d(6)}", f"{d(12)}", f"{d(10)}"])
    five = d(5)
    addr_en = r.choice([f"{k(200)} {place()} Lane, Flat {k(60)}, {place()}", f"{k(200)} {place()} Street, {place()}", f"{k(2000)} {place()} {r.choice('Road Avenue Drive Crescent Close Terrace Way'.split())}", f"P.O. Box {d(4)}, {place()}", f"{place()} House, {k(200)} {place()} Rd., {place()} {five}", f"{k(200)} {place()} Street, {place()} {five}", f"{k(99)} {place()} {place()}, {place()} {five}"])
    addr_de = r.choice([f"{place()}weg {k(200)}, {five} {place()}", f"{place()}str. {k(200)}, {five} {place()}", f"{place()}straße {k(99)}a, {five} {place()}", f"Am {place()}er Tor {k(200)}, {place()}", f"{place()}gasse {k(90)}", f"{place()} {k(90)}, {five} {place()}"])
    addr_fr = r.choice([f"{k(200)}, rue de {place()}, {five} {place()}", f"{k(200)} bis, av. {place()}, {place()}", f"{k(200)}, allée des {place()}, {five} {place()}-sur-Loue", f"{k(90)} quai {place()}", f"{k(90)} rue {place()}, {five} {place()}"])
    addr_es = r.choice([f"C/ {place()}, n.º {k(200)}, {place()}", f"Calle {place()} {k(200)}, 5.º B, {place()}", f"Avda. de {place()}, {k(200)}, {five} {place()}", f"Paseo de {place()} {k(90)}", f"Via {place()} {k(90)}, {five} {place()}"])
    st = made_c() + r.choice("ская ова ина ева".split())
    addr_ru = r.choice([f"ул. {st}, д. {k(200)}, кв. {k(99)}", f"г. {made_c()}ск, ул. {st}, {k(200)}", f"{d(6)}, г. {made_c()}ск, пр. {st}, д. {k(99)}, корп. {k(9)}", f"пер. {st}, дом {k(200)}", f"ул. {st}, {k(200)}"])
    addr_uk = r.choice([f"вул. {st}, буд. {k(200)}, кв. {k(99)}", f"м. {made_c()}ськ, вул. {st}, {k(200)}", f"вул. {st}, {k(90)}"])
    code = r.choice([f"{d(3)}.{d(4)}.{d(1)}", f"{d(4)}-{d(4)}", f"{d(4)}-{d(3)}", f"{d(3)}-{d(4)}-{d(2)}", f"{d(3)}-{d(4)}-{d(1)}", f"{d(2)}.{d(4)}.{d(1)}", f"{d(1)}.{d(2)}.{d(4)}", f"{d(3)}-{d(4)}/{d(2)}", f"{d(4)}.{d(2)}", f"{d(8)}", f"{d(11)}", f"{d(14)}", f"{d(4)}.{d(1)}", f"{d(2)}-{d(4)}-{d(2)}", f"{d(1)}-{d(4)}-{d(2)}", f"{d(5)}", f"{d(6)}", f"{up(2)}-00-{d(6)}", f"{up(2)}{d(4)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"])
    date = r.choice([f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"0{d(1)}/1{d(1)}/20{d(2)}"])
    nouns = lambda n: " ".join(r.sample(NOUNS, n))
    noun = lambda: r.choice(NOUNS_DE) if r.random() < 0.5 else r.choice(PARTS_DE[0]) + r.choice(PARTS_DE[1])
    dec = lambda: r.choice([f"{k(900)}.{d(1)}", f"{k(900)}.{d(2)}", k(900), k(900), f"{k(900)}%", f"0.{d(3)}", d(3)])
    row = " ".join(dec() for _ in range(r.randint(4, 14)))
    han = r.choice(HAN_FAMILY) + "".join(r.choice("伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀英霞平刚桂文云建华") for _ in range(r.randint(1, 2)))
    jap = r.choice("佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤 吉田 山田".split()) + r.choice(["", " "]) + r.choice("健太 美咲 翔 陽子 太郎 花子 直樹 恵".split())
    arab = r.choice("محمد أحمد فاطمة خالد ليلى يوسف سارة عمر".split()) + " " + r.choice("الحسن العلي حداد منصور النجار سالم الخطيب".split())
    hind = r.choice("राजेश सुनीता अमित प्रिया मोहन सीता विजय कविता".split()) + " " + r.choice("शर्मा वर्मा गुप्ता सिंह यादव पटेल मिश्रा".split())
    thai = r.choice("สมชาย สมหญิง วิชัย มาลี ประเสริฐ อรุณ สุดา".split()) + " " + r.choice("ใจดี ศรีสุข แสงทอง วงศ์ใหญ่ บุญมา".split())
    return {"row": row, "head": nouns(r.randint(2, 4)).upper(), "title": nouns(r.randint(2, 3)), "org": r.choice([nouns(2), nouns(3), f"{place()} {r.choice(NOUNS)}"]), "noun": noun(), "noun2": noun(), "adj": r.choice(ADJ_DE), "role": r.choice(ROLES), "role_c": r.choice(ROLES_C), "head_c": " ".join(r.sample(NOUNS_C, 2)), "place": place(), "place_c": made_c() + "ск", "name": name, "name_c": name_c, "last": last, "mail": mail, "phone": phone, "phone_c": phone_c, "id": ident, "id_c": ident_c, "iban": iban, "en": addr_en, "de": addr_de, "fr": addr_fr, "es": addr_es, "ru": addr_ru, "uk": addr_uk, "code": code, "date": date, "long": r.choice([d(r.randint(20, 90)), r.choice("0123456789") * r.randint(20, 90)]), "ver": f"{k(30)}.{k(30)}.{k(30)}", "n": k(99), "big": d(r.choice([4, 5, 6, 7])), "han": han, "jap": jap, "arab": arab, "hind": hind, "thai": thai}


SLOT_KIND = {"name": 4, "name_c": 4, "last": 4, "han": 4, "jap": 4, "arab": 4, "hind": 4, "thai": 4, "mail": 0, "phone": 1, "phone_c": 1, "id": 2, "id_c": 2, "iban": 2, "en": 3, "de": 3, "fr": 3, "es": 3, "ru": 3, "uk": 3}
TEMPLATES = """{row}
{row} {row}
{head}
{head} {n}
{head} {big}
{title}
{title} {n}. {n} [2]
{head_c}
{head_c} {n}
{head_c} Каждая неделя начинается рано.
{head_c} Вечер был тихим. Каждый Второй спит.
{org}, {n} {title}, {n}
The {org} and the {org} open at nine.
The {org} closes when {title} begins. It rains.
Our {title} explains how the {org} works.
In {place} the {org} was rebuilt. The River {place} is near.
Yesterday {name} called the office and left {phone}.
{role} {name} retires in May.
{role} {name} and {role} {name} disagree.
With {name} we walked home. For {name} it was new. But {name} stayed.
He noted {id} and left the room.
Was it {name} who called? It is {name} who sings.
{long} {long}
The label says {id} in pencil.
{name} · {en}
{name} · {en} {phone}
Someone wrote {id} on the back and a date.
My neighbour {name} moved to {en} last spring.
{name} said that the bus was late.
{name} and {name} share a desk.
We thank {name} for the gift.
A letter from {name} came today.
This was signed by {name} and sealed.
Is {name} at home? No, {name} left for {place}.
“I will go,” said {name}.
Mr. {last} will be back on {date}. Mrs. {last} stays.
Dear Mr {name}, your visit is booked.
Contact: {name}, {en}, phone {phone}
Name: {name} Address: {en} Phone: {phone} E-mail: {mail}
{name} · {en} · {mail} · {phone}
{name} | {phone} | {mail}
{name} ({mail}) wrote the minutes.
{name} (ID {id}) opened the account.
Dr. {name} sees patients at {en}.
Send the parcel to {en} before noon.
She lives at {en} with two cats.
They met in {en}.
Ring {phone} after six.
You can reach the nurse on {phone} or at {mail}.
Text us at {phone}
Questions? Write to {mail}.
Her passport number is {id}.
The driver’s licence {id} has expired.
Social security no. {id}
Pay into account {iban} by Friday.
The card shows {id} in small print.
The bracelet was engraved {id} last year.
Order no. {code} was shipped on {date}.
Invoice {code} and invoice {code} are open.
The serial {code} belongs to model {code}.
ISBN {code} is out of print.
Part {code} replaces part {code} in the list.
Ticket {code} was closed on {date}.
Item no. {code} was counted on {date}.
File {code} is in the cellar, see {code}.
Software version {ver} fixes the bug.
There were {big} visitors and {n} guides.
House {n} and Gate {n} are locked. Room {n} is free.
Gestern hat {name} angerufen, Telefon {phone}.
Die {noun} und das {noun2} sind fertig. Der {noun} fehlt.
{noun} {n} liegt vor. Die {noun2} von {place} bleibt.
Diese {noun} gehört zur {noun2}. Keine {noun} ohne {noun2}.
Die {noun} der {noun2} und den {noun} des {noun2} hat keiner.
Das {adj} {noun} und die {adj} {noun2} öffnen um neun.
{noun} {noun2} {noun}
{adj} {noun} {noun2}
{n} a. {noun} {noun2}, {n} b. {noun}, {n} c. {noun2} {noun}, {n}
| {noun} {noun2} | {n} | {row} | {noun} | {row}
{noun} {noun2} {adj} {noun} {noun2} {noun}
Auf dem Schild steht {id} und ein Pfeil.
Wie {name} schreibt, regnet es. Für {name} ist das neu.
Vor der {noun} der {noun2} warten alle. Was für ein {noun}! Die {noun2} kommt.
Leiter {name} fährt heim. Auch {name} fährt.
Unser Nachbar {name} wohnt in {de}.
Frau {last} und Herr {last} kommen später.
Herr {name} hat die {noun} bezahlt.
Der {noun} wurde von {name} geprüft.
Mit {name} sprach die {noun}.
Ansprechpartner: {name}, {de}, Fon {phone}
Das Paket geht an {de}.
Meine Nummer ist {phone}, Mail {mail}.
Reisepass {id} wurde verlängert.
Auf dem Ring war {id} eingraviert.
Hinten liest man {id} und einen Ort.
Laut {name} fährt der Zug.
Die Steuernummer lautet {id}.
Rechnung {code} vom {date} ist offen.
Bestellung Nr. {code} wurde storniert.
Artikel {code} ersetzt Artikel {code}.
Aktenzeichen {code}, siehe auch {code}.
Hier wohnte {name} bis {date}.
Hier, {name} a téléphoné au {phone}.
Notre voisine {name} habite au {fr}.
{name} · {fr} {mail}
Mme {last} et M. {last} sont absents.
La lettre de {name} est arrivée.
D’après {name}, il va pleuvoir. Avec {name}, tout change.
Selon {name}, le train part. Pour {name}, c’est loin.
Au dos on lit {id} et un nom.
L’étiquette indique {id} au crayon. L’{title} ouvre.
Le colis part pour le {fr} demain.
Écrivez à {mail} ou appelez le {phone}.
Le passeport {id} est périmé.
La bague porte la gravure {id} depuis.
La facture {code} est payée.
Commande n° {code} du {date}.
La pièce {code} remplace la pièce {code}.
Le Conseil Régional et la Grande Salle ferment.
Ayer llamó {name} desde el {phone}.
Nuestra vecina {name} vive en {es}.
{name} · {es} {phone}
La Sra. {last} y el Sr. {last} no vinieron.
La carta de {name} llegó hoy.
Como dijo {name}, va a llover. Con {name} todo cambia.
Según {name}, el tren sale. Para {name} es tarde.
Al dorso se ve {id} y un nombre.
El paquete va a {es} mañana.
Escriba a {mail} o llame al {phone}.
El pasaporte {id} ha caducado.
En el anillo se grabó {id} hace años.
La factura {code} está pagada.
Pedido n.º {code} del {date}.
La pieza {code} cambia por la pieza {code}.
El Mercado Central y la Oficina Nueva abren.
Вчера звонила {name_c}, телефон {phone_c}.
Наш сосед {name_c} живёт по адресу {ru}.
{name_c} сообщает, что автобус опоздал.
Письмо от {name_c} пришло сегодня.
Как сказал {name_c}, будет дождь.
Договор подписал {name_c} вчера.
Врач {name_c} принимает утром.
{role_c} {name_c} уходит в отпуск.
{role_c} {name_c} и {role_c} {name_c} спорят.
С обратной стороны видно {id_c} и подпись.
По словам {name_c}, поезд ушёл. Но {name_c} остался.
Г-н {name_c} не пришёл.
{name_c} (ИНН {id_c}) открыл счёт.
{name_c} · {ru} · {mail} · {phone_c}
Контакт: {name_c}, {ru}, моб. {phone_c}
Посылка идёт на {ru} завтра.
Паспорт {id_c} просрочен.
На кольце выбито {id_c} давно.
На обложці видно {id_c} і підпис.
{role_c} {name_c} відпочиває.
Удостоверение {id_c} найдено.
Пишите на {mail} или звоните {phone_c}.
Заказ {code} отправлен {date}.
Артикул {code} заменяет артикул {code}.
Счёт № {code} оплачен. Бланк {big} утерян.
Версия {ver} исправляет ошибку. Город {place_c} растёт.
Гора Большая и Новый Мост закрыты.
Учора дзвонила {name_c}, тел. {phone_c}.
Наш сусід {name_c} живе за адресою {uk}.
Лист від {name_c} прийшов сьогодні.
Договір підписав {name_c} учора.
{name_c} · {uk} · {mail} · {phone_c}
Посилка йде на {uk} завтра.
Посвідчення {id_c} знайдено.
Замовлення {code} надіслано {date}.
Рахунок {code} сплачено.
联系人：{han}，电话 {phone}。
客户{han}先生明天来。会议由{han}主持。
会议在北京举行，文件已经发出。
身份证 {id} 已登记。订单 {code} 已发货。
{jap}様、お電話 {phone} です。
{jap}さんが来ました。会議は終わりました。
注文 {code} は発送済みです。
السيد {arab} يسكن هنا. الهاتف {phone}.
وصل الدكتور {arab} أمس.
श्री {hind} ने पत्र लिखा। फ़ोन {phone}।
डॉ. {hind} आज आएँगे।
คุณ{thai} โทร {phone}
ส่งถึง นาย{thai} แล้ว""".split("\n")


def samples(p: Params) -> Iterator[tuple[str, set[tuple[int, int, int]]]]:
    """Generated texts of one to three sentences with the spans of their personal data."""
    r = random.Random(p.seed)
    for _ in range(p.sentences):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            values = _fill(r)
            if text:
                text += " "
            for part in re.split(r"(\{\w+\})", r.choice(TEMPLATES)):
                if part[:1] == "{":
                    slot = part[1:-1]
                    v = values.pop(slot, None) or _fill(r)[slot]
                    if slot in SLOT_KIND:
                        gold.add((len(text), len(text) + len(v), SLOT_KIND[slot]))
                    text += v
                else:
                    text += part
        yield text, gold


@lru_cache(maxsize=2)
def train(p: Params = Params()) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional log-likelihood. A gold span is matched by start and kind."""
    data = []
    for text, gold in samples(p):
        cands = candidates(text, p.lexicon)
        starts = {(a, k): b for a, b, k in gold}
        right = []
        for a, b, k, _ in cands:
            right.append((a, k) in starts and (k != 4 or starts[a, k] == b))
        data.append((cands, right))
    w: dict[str, float] = {}
    r = random.Random(p.seed + 1)
    for epoch in range(p.epochs):
        r.shuffle(data)
        rate = p.rate / (1 + 0.5 * epoch)
        for cands, right in data:
            if not cands:
                continue
            scores = [sum(w.get(f, 0.0) for f in c[3]) for c in cands]
            # several right candidates may share a start (longer and shorter reading): the longest is the gold one
            gold: dict[tuple[int, int], int] = {}
            for k, c in enumerate(cands):
                if right[k] and ((c[0], c[2]) not in gold or cands[gold[c[0], c[2]]][1] < c[1]):
                    gold[c[0], c[2]] = k
            chosen = set(gold.values())
            _, marginal = _segments(cands, scores)
            for k, c in enumerate(cands):
                g = (k in chosen) - marginal[k]
                if abs(g) > 1e-4:
                    for f in c[3]:
                        v = w.get(f, 0.0)
                        w[f] = v + rate * (g - p.decay * v)
    return {f: round(v, 4) for f, v in w.items() if abs(v) > 0.01}


def decode(text: str, w: dict[str, float], p: Params = Params()) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the best segmentation."""
    cands = candidates(text, p.lexicon)
    if not cands:
        return []
    get = w.get
    scores = [sum(get(f, 0.0) for f in c[3]) for c in cands]
    return [cands[k][:3] for k in best_segmentation(cands, scores)]


# ---------------------------------------------------------------------------------------------------------------------
# Tables


def find(df: DataFrame, id_col: str, w: dict[str, float]) -> DataFrame:
    """(id, kind, start_char, end_char) of all personal data. ``df``: id, text. Every text is read, whatever its script."""
    path = Params().lexicon
    shared = df.sparkSession.sparkContext.broadcast((w, lexicon(path)))  # both of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = shared.value
        use_lexicon(path, words)
        for b in batches:
            rows, kinds, starts, ends = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for a, z, k in decode(t, weights):
                    rows.append(i)
                    kinds.append(KINDS[k])
                    starts.append(a)
                    ends.append(z)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "kind", "start_char", "end_char"])

    src = df.select(F.col(id_col), "text").where(F.col("text").isNotNull())
    return src.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, kind string, start_char int, end_char int")


#: What any candidate needs: a figure, an at sign, or two capitals that may be a name.
HINT = r"[\d@]|\bat[\])]|\p{Lu}[^\s]*[\s ]+\p{Lu}"


def redact(df: DataFrame, id_col: str, w: dict[str, float]) -> DataFrame:
    """(id, text) with every personal datum replaced by ``[KIND]``."""
    path = Params().lexicon
    shared = df.sparkSession.sparkContext.broadcast((w, lexicon(path)))  # both of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = shared.value
        use_lexicon(path, words)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                if t:
                    for a, z, k in reversed(decode(t, weights)):
                        t = f"{t[:a]}[{KINDS[k].upper()}]{t[z:]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return df.select(F.col(id_col), "text").mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blocks").select("block_id", "text").where("block_id is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(blocks(spark, sf_dir), "block_id", train()).select("block_id", "kind", "start_char").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with its personal data replaced by typed placeholders."""
    return redact(blocks(spark, sf_dir).distinct(), "block_id", train())


def p2_redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for recognized lines."""
    lines = table(spark, sf_dir, "text_lines").select("line_id", "text").where("line_id is not null").distinct()
    return redact(lines, "line_id", train())
