"""Reading a product name: kind, flavour, fat, contents and the words that may name brand and line."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from polka.llm.forms import fold, one_script, to_cyrillic
from polka.llm.lexicon import FLAVOURS, KINDS, OTHER

_NOISE = re.compile(r"(?<=[a-zа-я])['`~^*|_](?=[a-zа-я])")
_WORD = re.compile(r"[a-zа-я0-9][a-zа-я0-9/\-&]*(?:\.-[а-я]+)?")
_FAT = re.compile(r"(?<![\d.])(\d{1,2}(?:\.\d+)?)\s*%")
_UNITS = {
    "кг": ("g", 1000.0), "kg": ("g", 1000.0), "кил": ("g", 1000.0), "г": ("g", 1.0), "гр": ("g", 1.0), "гра": ("g", 1.0),
    "g": ("g", 1.0), "gr": ("g", 1.0), "мл": ("ml", 1.0), "ml": ("ml", 1.0), "мил": ("ml", 1.0), "сл": ("ml", 10.0),
    "cl": ("ml", 10.0), "л": ("ml", 1000.0), "l": ("ml", 1000.0), "лит": ("ml", 1000.0), "шт": ("pcs", 1.0),
    "шту": ("pcs", 1.0), "pcs": ("pcs", 1.0), "pc": ("pcs", 1.0), "дес": ("pcs", 10.0),
}
_ANY = r"(кг|kg|кило(?:грамм\w*)?|грамм\w*|гр|gr|г|g|миллилитр\w*|мл|ml|сл|cl|литр\w*|л|l|шт(?:ук\w*)?|pcs|pc|десят\w*)(?!\w)"
_PACK = re.compile(r"(?<![\w.])(\d{1,4})\s*(?:шт\w*\.?|пак\w*\.?)?\s*(?:[xх×*]|по)\s*(\d+(?:\.\d+)?)\s*" + _ANY)
_FRAC = re.compile(r"(?<![\w./])(\d{1,2})/(\d{1,2})\s*" + _ANY)
_ONE = re.compile(r"(?<![\w./])(?:\d{1,4}[xх×*])?(\d+(?:\.\d+)?)\s*" + _ANY)
_THOUSANDS = re.compile(r"(?<![\w.№#/])(\d{1,3})\s(\d{3})(?![\d.])(?=\s*" + _ANY + ")")


_GRADE = re.compile(r"(?<!\w)[cс]\s?1(?!\w)|(?<![\w.])1\s?кат(?!\w)")
_FIRST = re.compile(r"(?<![\w.])1\s?с(?:орт)?(?!\w)")
_SORT = re.compile(r"1\s?[кс]|[cс]\s?1")
_DECIMAL = re.compile(r"(?<=\d),(?=\d)")


_ODD = re.compile(r"['`~^*|_]")
_PLAIN = re.compile("[а-я]+")
_GAP = re.compile(r"\d\s\d{3}")


def tidy(text: str | None) -> str:
    t = fold(text or "").replace("\xa0", " ").replace("\u202f", " ")
    if _ODD.search(t):
        t = _NOISE.sub("", t)
    if "," in t:
        t = _DECIMAL.sub(".", t)
    return _THOUSANDS.sub(r"\1\2", t) if _GAP.search(t) else t


def contents(text: str | None) -> tuple[str | None, float | None]:
    """(dimension, total) a text states, as :func:`polka.functions.measures.with_contents`."""
    t = tidy(text)
    if m := _PACK.search(t):
        dim, f = _UNITS[m[3][:3]]
        return dim, float(m[1]) * float(m[2]) * f
    if (m := _FRAC.search(t)) and float(m[2]):
        dim, f = _UNITS[m[3][:3]]
        return dim, float(m[1]) / float(m[2]) * f
    if re.search(r"(?<!\w)(?:полкило|пол[- ]?кило(?:грамма)?)(?!\w)", t):
        return "g", 500.0
    if re.search(r"(?<!\w)пол[- ]?литра(?!\w)", t):
        return "ml", 500.0
    found = [(float(m[1]) * _UNITS[m[2][:3]][1], _UNITS[m[2][:3]][0]) for m in _ONE.finditer(t)]
    for dims in (("g", "ml"), ("pcs",)):
        if some := [x for x in found if x[1] in dims and x[0] > 0]:
            total, dim = max(some)
            return dim, total
    return None, None


def _starts(word: str, stem: str) -> bool:
    return word == stem[1:] if stem[0] == "=" else word.startswith(stem)


def _nearly(word: str, stem: str) -> bool:
    n = len(stem)
    if n < 5 or stem[0] == "=" or len(word) < n:
        return False
    # of two texts of one length: at most one letter another one, or two neighbours swapped
    i = next((i for i in range(n) if word[i] != stem[i]), n)
    return word[i + 1 : n] == stem[i + 1 :] or (word[i + 2 : n] == stem[i + 2 :] and word[i : i + 2] == stem[i + 1] + stem[i])


@dataclass
class Product:
    kind: str | None = None
    fat: float | None = None
    dim: str | None = None
    total: float | None = None
    words: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


class Parser:
    """Parses names with a lexicon of kinds, flavours and other words (all parameters).

    What a word means is worked out once and remembered: shelf words repeat in most names.
    """

    def __init__(self, kinds=KINDS, flavours=FLAVOURS, other=OTHER):
        self.ways = [(k, frozenset(way.split()), sum(len(x) + 4 for x in way.split())) for k, ways in kinds.items() for way in ways]
        self.flavours = flavours
        self.kind_stems = sorted({s for _, way, _ in self.ways for s in way})
        self.single = [(k, next(iter(way))) for k, way, _ in self.ways if len(way) == 1]
        stems = {*self.kind_stems, *(s for f in flavours.values() for ss in f.values() for s in ss)}
        self.exact = {s.lstrip("=") for s in stems} | {fold(w).strip(".!") for w in other}
        self.prefixes = tuple(s for s in stems if s[0] != "=" and len(s) >= 4)
        self.script = lru_cache(40_000)(self._script)
        self.stem_sizes = sorted({len(s) for s in self.kind_stems if s[0] != "="})
        self.stem_set = frozenset(self.kind_stems)
        self.stems_of = lru_cache(40_000)(lambda w: self.stem_set & {"=" + w, *(w[:k] for k in self.stem_sizes)})
        self.is_name = lru_cache(40_000)(self._is_name)
        self.contents = lru_cache(20_000)(contents)
        self.flavour_of = lru_cache(40_000)(self._flavour_of)
        self.kind_of = lru_cache(40_000)(self._kind_of)
        self.shelf = lru_cache(40_000)(self._shelf)
        self.kind_near = lru_cache(20_000)(lambda w: next((k for k, s in self.single if _nearly(w, s)), None))

    def _script(self, w: str) -> str:
        if _PLAIN.fullmatch(w):
            return w
        return one_script(w) if sum(ch.isalpha() for ch in w) >= 3 and w[0] not in "123456789" else w

    def words(self, text: str | None) -> list[str]:
        return self._words(tidy(text))

    def _words(self, t: str) -> list[str]:
        if _SORT.search(t):
            t = _GRADE.sub(" с1 ", t)
            t = _FIRST.sub(" 1с ", t)
        return [self.script(w) for w in _WORD.findall(t)]

    def kind(self, words: list[str]) -> str | None:
        met = frozenset().union(*map(self.stems_of, words))
        if met and (best := self.kind_of(met)):
            return best
        return next((k for w in words if (k := self.kind_near(w))), None)

    def _kind_of(self, met: frozenset[str]) -> str | None:
        best, score = None, 0
        for k, way, s in self.ways:
            if s > score and way <= met:
                best, score = k, s
        return best

    def _flavour_of(self, word: str, kind: str, near: bool) -> str | None:
        test = _nearly if near else _starts
        return next((f for f, stems in self.flavours[kind].items() if any(test(word, s) for s in stems)), None)

    def flavour(self, words: list[str], kind: str | None) -> str | None:
        """The flavour the words name, given the kind; None if they name none or several."""
        if kind not in self.flavours:
            return None
        for near in (False, True):
            hits = {f for w in words if (f := self.flavour_of(w, kind, near))}
            if hits:
                return hits.pop() if len(hits) == 1 else None
        return None

    def _is_name(self, word: str) -> bool:
        """Whether a word may name a brand or a line: letters only, in no list of shelf words."""
        w = word.strip("-&")
        return len(w) >= 4 and w.replace("-", "").isalpha() and w not in self.exact and not w.startswith(self.prefixes)

    def parse(self, name: str | None, size: str | None = None) -> Product:
        t = tidy(name)
        words = self._words(t)
        fat = _FAT.search(t) if "%" in t else None
        fat = float(fat[1]) if fat and 0 < float(fat[1]) <= 90 else None
        dim, total = self.contents(size)
        if dim is None:
            dim, total = contents(name)
        names = [cyrillic(w) for w in words if self.is_name(w)]
        return Product(self.kind(words), fat, dim, total, words, list(dict.fromkeys(names)))

    def joined(self, words: list[str]) -> list[str]:
        """Neighbouring words as one, for words that recognition has split; not two shelf words."""
        out, a = [], ""
        for b in words:
            shelf = self.shelf(b)
            if shelf is None:
                continue
            if not shelf and a and 5 <= len(a) + len(b) <= 14 and min(len(a), len(b)) <= 5:
                out.append(cyrillic(a + b))
            a = "" if shelf else b
        return list(dict.fromkeys(out))

    def _shelf(self, w: str) -> bool | None:
        """Whether a word is one of the shelf; None for what is no word of letters."""
        if not w.replace("-", "").isalpha():
            return None
        return w in "сивкоуа" or w in self.exact or (len(w) >= 4 and not self.is_name(w))


@lru_cache(40_000)
def cyrillic(word: str) -> str:
    w = word.strip("-&")
    return to_cyrillic(w) if re.search("[a-z]", w) else w
