"""Text decoded with the wrong character encoding: finding and restoring it.

For every pair (true encoding, wrong encoding) the garbled form of each Russian letter
(true encoding UTF-8) or letter pair (single-byte encodings) is generated. An
Aho-Corasick automaton over all of them says which pairs a word may be damaged by; the word
is turned back by each and the reading with the likeliest letters wins. Only matched
words or sequences are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODINGS = ("cp1251", "cp866", "koi8-r", "iso8859-5", "mac-cyrillic", "cp1252", "latin-1")
TRUE = ("utf-8", "cp1251", "cp866", "koi8-r", "iso8859-5", "mac-cyrillic")
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LETTERS = RUSSIAN + RUSSIAN.upper()
SOUND = set(LETTERS + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,:;!?%/\\«»\"'`()[]{}+-–—_*&#№@=<>|°²³½¼×•…®©™€₽$^~“”„’‘\t\n\r")
SIGNS = "«»—–№…“”„’‘×°®™\u00a0"
#: Signs that a wrong single-byte reading puts beside letters; each lowers a reading's rank.
ODD = set("€…®©™‘’“”„—–•°†‡")
#: Log-probability that a letter pair never seen gets, and that of a character out of place.
UNSEEN, STRANGE = -9.0, -12.0
MARGIN = 1.5
_NATURAL = SOUND | {" "}
_PARTS = re.compile(r"[А-Яа-яЁё]+|[^А-Яа-яЁё]")
_MIXED = re.compile(r"[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z]")
# One-letter words of Russian as Latin-1 shows their CP1251 bytes.
ALONE = {"ñ": "с", "è": "и", "â": "в", "ê": "к", "î": "о", "ó": "у"}


def _decoder(enc: str) -> list[str]:
    """Character of each byte; bytes an encoding leaves open are control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


DECODE = {e: _decoder(e) for e in ENCODINGS}
ENCODE = {e: {ch: b for b, ch in reversed(list(enumerate(t)))} for e, t in DECODE.items()}
#: Of two single-byte encodings (true, wrong): what each character shown stands for.
MEANT = {(a, b): {ch: DECODE[a][x] for ch, x in ENCODE[b].items()} for a in TRUE if a != "utf-8" for b in ENCODINGS if a != b}
PAIRS = [(a, b) for a in TRUE for b in ENCODINGS if a != b]
#: Of the same, by pair: the characters whose reading may stand in a sound text.
READABLE = {k: frozenset(ch for ch, x in MEANT[p].items() if x in _NATURAL) for k, p in enumerate(PAIRS) if p in MEANT}
UTF8 = [k for k, (a, _) in enumerate(PAIRS) if a == "utf-8"]


def garble(text: str, true: str, wrong: str) -> str | None:
    try:
        return "".join(DECODE[wrong][b] for b in text.encode(true))
    except UnicodeEncodeError:
        return None


def ungarble(text: str, true: str, wrong: str) -> str | None:
    """``text`` read again as ``true``; None where it cannot have come from ``wrong`` so."""
    try:
        if true == "utf-8":
            back = ENCODE[wrong]
            return bytes([back[ch] for ch in text]).decode(true)
        meant = MEANT[true, wrong]
        return "".join([meant[ch] for ch in text])
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(1)
def automaton():
    """Garbled sequences of all pairs; the value is the set of pairs a sequence speaks for."""
    import ahocorasick

    found: dict[str, set[int]] = {}
    for k, (a, b) in enumerate(PAIRS):
        units = list(LETTERS + SIGNS) if a == "utf-8" else [x + y for x in LETTERS for y in LETTERS]
        for u in units:
            g = garble(u, a, b)
            if g and g != u:
                found.setdefault(g, set()).add(k)
    auto = ahocorasick.Automaton()
    for g, ks in found.items():
        auto.add_word(g, (g, frozenset(ks)))
    auto.make_automaton()
    return auto


class Repairer:
    """Restores texts, given the log-probabilities of lower-case letter pairs ('^' and '$' are ends)."""

    def __init__(self, pairs: dict[str, float]):
        self.pairs = pairs
        self.word = lru_cache(50_000)(self._word)
        self.sequences = lru_cache(50_000)(self._sequences)

    def likelihood(self, text: str) -> float:
        """Mean log-probability of the letter pairs of ``text``; characters out of place count as STRANGE."""
        total, n = 0.0, 0
        for part in _PARTS.findall(text):
            if part[0] in LETTERS:
                low = f"^{part.lower()}$"
                for i in range(len(low) - 1):
                    total += self.pairs.get(low[i : i + 2], UNSEEN)
                    n += 1
                if not part.islower():
                    total += UNSEEN * sum(1 for x, y in zip(part, part[1:], strict=False) if x.islower() and y.isupper())
            elif part not in SOUND:
                total += STRANGE
                n += 1
            elif part in ODD:
                total += UNSEEN
                n += 1
        return total / n if n else 0.0

    def _natural(self, text: str) -> bool:
        return _NATURAL.issuperset(text) and not _MIXED.search(text)

    def _word(self, word: str) -> tuple[str, int]:
        """The word restored and the pair it was damaged by, or itself and -1."""
        if word.isascii():
            return word, -1
        votes: set[int] = set()
        for _, (_, ks) in automaton().iter(word):
            votes |= ks
        strange = not SOUND.issuperset(word)
        if strange:
            votes.update(UTF8)
        best, pair, top = word, -1, self.likelihood(word) + MARGIN
        letters = sum(ch in LETTERS for ch in word)
        readings = [(k, ungarble(word, *PAIRS[k])) for k in votes if k not in READABLE or READABLE[k].issuperset(word)]
        layered = [x for x in readings if x[1] and PAIRS[x[0]][0] == "utf-8" and not self._natural(x[1])]
        for _ in range(2):  # text damaged twice or thrice
            layered = [(k, r) for k, t in layered for p in UTF8 if (r := ungarble(t, *PAIRS[p])) and r != t]
            readings += layered
        for k, r in readings:
            if r is None or not self._natural(r):
                continue
            size = sum(ch in LETTERS for ch in r)
            if not size or (not strange and size < 5):
                continue  # a short word of sound letters says too little on its own
            s = self.likelihood(r) + (0.2 if not strange else 0.0) * min(0, size - letters)
            if s > top:
                best, pair, top = r, k, s
        return best, pair

    def _sequences(self, word: str) -> str:
        """Sequences of an UTF-8 pair replaced where whole words cannot be (lost bytes, glued words)."""
        hits: dict[int, list[tuple[int, int, str]]] = {}
        for end, (g, ks) in automaton().iter(word):
            for k in ks:
                if PAIRS[k][0] == "utf-8" and len(g) > 1:
                    hits.setdefault(k, []).append((end - len(g) + 1, end + 1, g))
        best, most = word, 0
        for k, spans in hits.items():
            covered = {i for a, b, _ in spans for i in range(a, b)}
            foreign = sum(1 for i in covered if word[i] not in SOUND or word[i] in "РСÐÑ")
            if len(spans) >= 2 and foreign * 2 >= len(covered) and len(covered) > most:
                out, at = [], 0
                for a, b, g in sorted(spans):
                    if a < at:
                        continue
                    out += [word[at:a], ungarble(g, *PAIRS[k]) or g]
                    at = b
                best, most = "".join([*out, word[at:]]), len(covered)
        return best

    def restore(self, text: str) -> str:
        """``text`` with damaged words restored, up to three layers of damage; others untouched."""
        for _ in range(3):
            words = text.split(" ")
            done = [self.word(w) for w in words]
            hits = [k for _, k in done if k >= 0]
            whole = sum(not w.isascii() and len(w) > 2 for w in words)
            main = max(set(hits), key=hits.count) if hits else -1
            ruled = hits.count(main) * 5 >= whole * 3 and main >= 0  # the pair that damaged most words
            out = []
            for i, (w, (r, k)) in enumerate(zip(words, done, strict=True)):
                if ruled and k not in (-1, main) and (again := ungarble(w, *PAIRS[main])) and self._natural(again):
                    r = again  # the pair that damaged the other words is likelier than another one
                if k < 0 and not w.isascii():
                    strange = bool(hits) and not SOUND.issuperset(w)
                    for n in sorted(set(hits), key=lambda n: -hits.count(n)):
                        again = ungarble(w, *PAIRS[n])
                        if again and self._natural(again) and any(ch in LETTERS for ch in again) and (strange or (ruled and n == main) or self.likelihood(again) > self.likelihood(w) + 0.5):
                            r = again
                            break
                    else:
                        alone = ALONE.get(w)
                        latin = alone and [j for j in (i - 1, i + 1) if 0 <= j < len(words) and re.match("[A-Za-z]", words[j])]
                        r = alone if alone and not latin else self.sequences(w)
                out.append(r)
            new = " ".join(out)
            if new == text:
                break
            text = new
        return text


def is_lost(text: str) -> bool:
    """Whether letters are gone for good: replacement characters or runs of question marks."""
    return "�" in text or re.search(r"\?\?", text) is not None


#: What only damage leaves behind: box drawing, control characters, letters no product name is written with.
LEFTOVER = re.compile("[\u2500-\u25a0\u0080-\u009f\u00ad\u0402\u0403\u0409-\u040c\u040f\u0452\u0453\u0459-\u045c\u045f\u0490\u0491]|[\u00d0\u00d1\u00c2\u00c3][\u0080-\u00bf]|\u0420\u00a0")


def letter_pairs(texts: DataFrame, column: str) -> dict[str, float]:
    """Log-probability of the next letter over all rows; bounded by the alphabet, not by the data."""
    clean = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), "[^А-Яа-яЁё]+", " "))
    words = texts.select(F.explode(F.split(clean, " ")).alias("w")).where(F.length("w") > 1).groupBy("w").count()
    marked = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: marked.substr(i, F.lit(2)))).alias("g"), "count")
    rows = grams.groupBy("g").agg(F.sum("count").alias("n")).collect()  # at most 34 x 34 rows
    first: dict[str, int] = {}
    for r in rows:
        first[r["g"][0]] = first.get(r["g"][0], 0) + r["n"]
    return {r["g"]: math.log(r["n"] / first[r["g"][0]]) for r in rows}


def restore_texts(df: DataFrame, column: str = "product_name") -> DataFrame:
    """``df`` with ``restored``, ``damaged`` and ``restorable``.

    ``restored`` is the text with every damaged span put right that can be; NULL stays NULL,
    '' stays ''. ``damaged`` also covers text whose letters are lost; ``restorable`` is
    whether nothing suspicious is left. Columns of those names in ``df`` are replaced.
    """
    pairs = letter_pairs(df, column)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(pairs)
        for s in it:
            out = [None if t is None else repairer.restore(t) for t in s]
            bad = [t is not None and (r != t or is_lost(t) or LEFTOVER.search(t) is not None) for t, r in zip(s, out, strict=True)]
            good = [t is None or not (is_lost(r) or LEFTOVER.search(r)) for t, r in zip(s, out, strict=True)]
            yield pd.DataFrame({"restored": out, "damaged": bad, "restorable": good})

    udf = F.pandas_udf(run, "restored string, damaged boolean, restorable boolean")
    names = [c for c in df.columns if c not in ("restored", "damaged", "restorable")]
    return df.withColumn("_r", udf(F.col(column))).select(*names, "_r.restored", "_r.damaged", "_r.restorable")
