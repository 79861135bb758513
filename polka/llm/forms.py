"""Spellings of one word: look-alike letters, the other script, the other keyboard layout."""

from __future__ import annotations

import re
from functools import lru_cache

# Letters that look alike, Latin to Cyrillic and back.
TO_CYRILLIC = dict(zip("aeopcyxkmtbh", "аеорсухкмтвн", strict=True))
TO_LATIN = {v: k for k, v in TO_CYRILLIC.items()}
DIGIT_CYRILLIC = dict(zip("0346", "озчб", strict=True))
DIGIT_LATIN = dict(zip("015", "ols", strict=True))
# The Russian keyboard under the English one.
KEYBOARD = dict(zip("qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюё", strict=True))
# Letters of the other script by sound.
CYR_LAT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
LAT_CYR = [
    ("shch", "щ"), ("sch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"),
    ("yo", "е"), ("qu", "кв"), ("a", "а"), ("b", "б"), ("v", "в"), ("w", "в"), ("g", "г"), ("d", "д"), ("e", "е"),
    ("z", "з"), ("i", "и"), ("j", "ж"), ("y", "и"), ("k", "к"), ("c", "к"), ("q", "к"), ("l", "л"), ("m", "м"), ("n", "н"),
    ("o", "о"), ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("h", "х"), ("x", "кс"),
]

_CYR = re.compile("[а-я]")
_LAT = re.compile("[a-z]")


def fold(text: str) -> str:
    return text.lower().replace("ё", "е")


def one_script(word: str) -> str:
    """A lower-case word with look-alike letters and digits brought into its main script."""
    c, n = len(_CYR.findall(word)), len(_LAT.findall(word))
    if not c and not n:
        return word
    own_c = sum(1 for ch in word if _CYR.match(ch) and ch not in TO_LATIN)
    own_l = sum(1 for ch in word if _LAT.match(ch) and ch not in TO_CYRILLIC)
    if own_c > own_l or (own_c == own_l and c >= n):
        return "".join(TO_CYRILLIC.get(ch) or DIGIT_CYRILLIC.get(ch, ch) for ch in word)
    return "".join(TO_LATIN.get(ch) or DIGIT_LATIN.get(ch, ch) for ch in word)


@lru_cache(20_000)
def to_latin(word: str) -> str:
    return "".join(CYR_LAT.get(ch, ch) for ch in word)


@lru_cache(20_000)
def to_cyrillic(word: str) -> str:
    out, i = [], 0
    while i < len(word):
        for lat, cyr in LAT_CYR:
            if word.startswith(lat, i):
                out.append(cyr)
                i += len(lat)
                break
        else:
            out.append(word[i])
            i += 1
    return "".join(out)


def retyped(text: str) -> str:
    """What the keys of a lower-case text give on the Russian layout."""
    return fold("".join(KEYBOARD.get(ch, ch) for ch in text))


@lru_cache(30_000)
def distance(a: str, b: str, limit: int = 9) -> int:
    """Edits with swaps of neighbours (optimal string alignment); ``limit + 1`` beyond ``limit``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    # what both begin or end with costs nothing
    i, n, m = 0, len(a), len(b)
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    if not a or not b:
        return len(a) + len(b)
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return min(one[-1], limit + 1)


def deletes(word: str, n: int) -> set[str]:
    """The word and all that deleting up to ``n`` of its letters gives.

    Two words within ``n`` edits (swaps of neighbours counting as one) share one of these.
    """
    out, edge = {word}, {word}
    for _ in range(n):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out
