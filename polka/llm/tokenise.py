"""Encoding a corpus with a public byte-level BPE: overlapping chunks, stitched at common boundaries.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised in
parallel. Where both chunks of an overlap have a pre-token boundary at the same place they are
in step: the left chunk is used before it and the right one from it on. The pieces between
boundaries are then encoded. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polka.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 16_384, 512


class Encoder:
    """Encodes pre-tokens and whole texts with the ranks of a vocabulary file."""

    def __init__(self, data: bytes):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.bytes_of = None

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        if self.bytes_of is None:
            self.bytes_of = {v: k for k, v in self.ranks.items()}
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """Under a megabyte; it goes to the executors with the tasks, which need no file."""
    with open(path, "rb") as f:
        return f.read()


def stitch(left: list[int], right: list[int], end: int) -> int:
    """The first offset that both boundary lists have, before the last two characters of the left chunk; -1 if none.

    What the left chunk says there is exact, since no pre-token looks further than one
    character ahead, and the right chunk is in step from there on.
    """
    common = set(left) & set(right)
    sound = [o for o in common if o < end - 2]
    return min(sound) if sound else -1


def chunks_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    for start in range(0, max(1, len(text)), size):
        yield start, text[start : start + size + overlap]
        if start + size >= len(text):
            return


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids``: every document once, empty array for an empty or NULL text.

    Repeated rows of a key count once. Texts of one chunk are encoded where they are read; of
    longer ones the chunks travel, and no task holds more than a chunk and its neighbour's
    boundaries until the ids of a document are put together. A document with an overlap
    without a common boundary (a single endless word) is encoded in one piece.
    """
    data = read_vocabulary(vocabulary)
    once = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])

    def encode(s: pd.Series) -> pd.Series:
        e = encoder(data)
        return s.map(lambda t: e.encode(t) if t else [])

    to_ids = F.pandas_udf(encode, "array<int>")
    long = F.coalesce(F.length("text") > size, F.lit(False))
    short = once.where(~long).select("doc_id", to_ids(F.coalesce("text", F.lit(""))).alias("ids"))

    def split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(data)
        for df in it:
            for doc, t in zip(df["doc_id"], df["text"], strict=True):
                for n, (start, part) in enumerate(chunks_of(t, size, overlap)):
                    at = [start + o for o in e.starts(part)]
                    head = [o for o in at if start <= o < start + overlap]
                    # a piece must not end in white space: how that is split depends on what follows
                    tail = [o for o in at if start + size <= o and not part[o - start - 1].isspace()]
                    yield pd.DataFrame({"doc_id": [doc], "n": [n], "start": [start], "part": [part], "head": [head], "tail": [tail]})

    parts = cut(once.where(long).mapInPandas(split, "doc_id bigint, n int, start bigint, part string, head array<bigint>, tail array<bigint>"), "chunks")
    order = Window.partitionBy("doc_id").orderBy("n")

    def meet(tails: pd.Series, heads: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else stitch(list(t), list(h), int(e)) for t, h, e in zip(tails, heads, ends, strict=True)], dtype="Int64")

    edges = parts.select("doc_id", "n", "tail", (F.col("start") + F.length("part")).alias("end"), F.lead("head").over(order).alias("next_head"))
    edges = edges.select("doc_id", "n", F.pandas_udf(meet, "bigint")("tail", "next_head", "end").alias("to"))
    edges = cut(edges.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0))), "edges")
    broken = edges.where(F.coalesce("to", F.lit(0)) < 0).select("doc_id").distinct()
    whole = once.where(long).join(broken, "doc_id", "left_semi").select("doc_id", to_ids("text").alias("ids"))
    kept = parts.select("doc_id", "n", "start", "part").join(edges, ["doc_id", "n"]).join(broken, "doc_id", "left_anti")
    piece = F.col("part").substr((F.col("from") - F.col("start") + 1).cast("int"), F.when(F.col("to").isNull(), F.length("part")).otherwise(F.col("to") - F.col("from")).cast("int"))
    encoded = kept.select("doc_id", "n", to_ids(piece).alias("ids"))
    joined = encoded.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(whole).unionByName(joined)


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``tokens``; 0 for empty and NULL texts."""
    data = read_vocabulary(vocabulary)

    def count(s: pd.Series) -> pd.Series:
        e = encoder(data)
        return s.map(lambda t: len(e.encode(t)) if t else 0).astype("int64")

    return docs.withColumn("tokens", F.pandas_udf(count, "bigint")(text))
