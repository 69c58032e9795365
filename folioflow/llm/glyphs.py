"""Shapes of letters as a recognizer confuses them."""

from __future__ import annotations

import re
from functools import lru_cache

#: What a recognizer reads for a letter (letter, misreading), Latin and Cyrillic.
CONFUSED = [
    ("e", "c"), ("i", "!"), ("n", "ri"), ("o", "0"), ("t", "f"), ("s", "5"), ("l", "1"), ("u", "ii"), ("g", "9"), ("h", "b"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("b", "6"), ("z", "2"), ("q", "9"), ("i", "1"), ("l", "i"), ("l", "|"), ("i", "|"), ("l", "!"), ("b", "h"), ("n", "r!"), ("u", "!i"), ("u", "i!"),
    ("е", "с"), ("о", "0"), ("н", "п"), ("т", "г"), ("и", "н"), ("л", "д"), ("ч", "4"), ("з", "3"), ("ы", "ьт"), ("б", "6"), ("ё", "ö"), ("ш", "щ"), ("и", "й"), ("і", "!"), ("і", "1"), ("ї", "і"),
]
LOST = "�"  # stands for any one letter


def _classes() -> dict[str, str]:
    """Single characters joined by confusions share one class sign; two-sign misreadings are folded first."""
    group: dict[str, str] = {}

    def root(c: str) -> str:
        while group.setdefault(c, c) != c:
            c = group[c]
        return c

    for a, b in CONFUSED:
        if len(a) == len(b) == 1:
            ra, rb = sorted((root(a), root(b)))
            group[rb] = ra
    return {c: root(c) for c in group}


SIGN = _classes()
_TABLE = str.maketrans(SIGN)
#: Two-sign misreadings, in class signs, and the class of the letter they stand for.
_TO = {b.translate(_TABLE): a.translate(_TABLE) for a, b in CONFUSED if len(b) == 2}
_FOLD = re.compile("|".join(re.escape(b) for b in sorted(_TO)))


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """Class signs of a lower-case word. Equal for a word and its misreadings by the table, but for rare overlaps."""
    return _FOLD.sub(lambda m: _TO[m.group()], word.translate(_TABLE))


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSED:
    _BY_FIRST.setdefault(_a, []).append((_a, _b))


def misreads(word: str, read: str) -> int:
    """How many confusions turn ``word`` into ``read``; -1 when they do not. A lost sign stands for any letter."""
    states = {0: 0}
    at = [dict() for _ in range(len(word) + 1)]
    at[0] = states
    for i in range(len(word)):
        for j, cost in at[i].items():
            if j < len(read) and read[j] == word[i] and at[i + 1].get(j + 1, 99) > cost:
                at[i + 1][j + 1] = cost
            if j < len(read) and read[j] == LOST and at[i + 1].get(j + 1, 99) > cost + 1:
                at[i + 1][j + 1] = cost + 1
            for _, b in _BY_FIRST.get(word[i], ()):
                if read.startswith(b, j) and at[i + 1].get(j + len(b), 99) > cost + 1:
                    at[i + 1][j + len(b)] = cost + 1
    return at[len(word)].get(len(read), -1)


def near(a: str, b: str) -> bool:
    """Equal, equal in shape, or one misread sign apart (words of at least four letters; figures must agree in shape)."""
    if a == b or skeleton(a) == skeleton(b):
        return True
    if LOST in a or LOST in b:
        return len(a) == len(b) and all(x == y or LOST in (x, y) for x, y in zip(a, b))
    if min(len(a), len(b)) < 4 or a.isdigit() or b.isdigit() or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]
