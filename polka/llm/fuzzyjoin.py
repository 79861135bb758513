"""Joining words by edit distance: equal deletions of letters find the candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polka.llm.forms import deletes, distance


def edits_allowed(n: int) -> int:
    """Edits that may separate two spellings of a word of ``n`` letters."""
    return 0 if n <= 3 else 1 if n <= 6 else 2


def _keys(column: str) -> Column:
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(deletion_keys(words.tolist()), dtype=object)

    return F.pandas_udf(run, "array<bigint>")(column)


#: Bits that a hash does without: what is shuffled gets shorter, and what meets by chance is compared anyway.
_SPARE = np.uint64(24)


def deletion_keys(words: list[str]) -> list[list[int]]:
    """Hashes of each word and of what deleting up to its allowed edits in letters leaves.

    Words of one length are hashed together: a hash is the sum of a mixed number for each
    letter and its place, so what a deletion leaves is three differences of running sums.
    """
    out: list[list[int]] = [[] for _ in words]
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, at in by_length.items():
        letters = np.array([[ord(ch) for ch in words[k]] for k in at], dtype=np.uint64).reshape(len(at), n)
        places = np.arange(n, dtype=np.uint64)
        # running sums with the letters where they are, one place and two places before
        sums = [np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum(_mix(letters, places - np.uint64(d)), axis=1, dtype=np.uint64)], axis=1) for d in range(3)]
        keys, allowed = [sums[0][:, n]], edits_allowed(n)
        for i in range(n if allowed else 0):
            keys.append(sums[0][:, i] + sums[1][:, n] - sums[1][:, i + 1])
            for j in range(i + 1, n if allowed > 1 else 0):
                keys.append(sums[0][:, i] + sums[1][:, j] - sums[1][:, i + 1] + sums[2][:, n] - sums[2][:, j + 1])
        for k, row in zip(at, (np.stack(keys, axis=1) >> _SPARE).tolist(), strict=True):
            out[k] = list(set(row))
    return out


def _mix(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    x = letters * np.uint64(0x9E3779B97F4A7C15) + (places + np.uint64(3)) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_within(word: Column, n: Column) -> Column:
    """Hashes of what deleting up to ``n`` letters leaves; words within ``n`` edits share one."""

    def run(words: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([[_hash(k) for k in deletes(w, d)] for w, d in zip(words, ns, strict=True)])

    return F.pandas_udf(run, "array<bigint>")(word, n)


def _hash(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key) - (1 << 63)


def edits(a: Column, b: Column) -> Column:
    """Edit distance with swaps of neighbours; 3 stands for more than 2."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y, 2) for x, y in zip(a, b, strict=True)], dtype="int32")

    return F.pandas_udf(run, "int")(a, b)


def similar_words(left: DataFrame, right: DataFrame, left_col: str = "word", right_col: str = "word") -> DataFrame:
    """``(left_word, right_word, edits)`` for all distinct words within the allowed edits.

    The allowed number follows the longer word. Both inputs are made distinct first; no word
    is compared with all others: they meet on the deletions they share.
    """
    spread = lambda df, c, name: df.select(F.col(c).alias(name)).where(F.length(c) > 0).distinct()
    a = spread(left, left_col, "left_word").withColumn("k", F.explode(_keys("left_word")))
    b = spread(right, right_col, "right_word").withColumn("k", F.explode(_keys("right_word")))
    met = a.join(b, "k").select("left_word", "right_word", edits(F.col("left_word"), F.col("right_word")).alias("edits"))
    n = F.greatest(F.length("left_word"), F.length("right_word"))
    return met.where(F.col("edits") <= F.when(n <= 3, 0).when(n <= 6, 1).otherwise(2)).distinct()
