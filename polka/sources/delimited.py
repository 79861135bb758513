"""Delimited catalogue files: encoding and delimiter found from the head, everything read as text."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 20 * 2**20, 100_000, 100, 2_000_000
HEAD = 64 * 1024
SUFFIXES = {".csv", ".tsv", ".xlsx", ".xlsm", ".xltx", ".xltm", ".ods", ".xls", ".xlt", ".xlsb"}


class FileError(ValueError):
    """A file that is not taken, with the reason."""


def sniff(head: bytes, suffix: str) -> tuple[str, str]:
    """(Java charset, separator) of a file's head; UTF-8 unless its bytes say otherwise."""
    for enc, java in (("utf-8-sig", "UTF-8"), ("cp1251", "windows-1251")):
        try:
            text = head.decode(enc)
            break
        except UnicodeDecodeError as e:
            if enc == "utf-8-sig" and e.start >= len(head) - 4:  # cut within a character
                text, java = head[: e.start].decode("utf-8-sig"), "UTF-8"
                break
    else:
        raise FileError("encoding")
    if suffix == ".tsv":
        return java, "\t"
    try:
        return java, csv.Sniffer().sniff("\n".join(text.splitlines()[:20]), ";,|\t").delimiter
    except csv.Error:
        first = text.splitlines()[0] if text else ""
        return java, max(";,|\t", key=first.count)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with ``row_idx``; rows and columns without any value are dropped.

    Refuses empty files, files over 20 MiB, 100 000 rows, 100 columns or two million cells.
    """
    suffix = path[path.rfind(".") :].lower()
    files = spark.read.format("binaryFile").load(path)
    info = files.agg(F.sum("length").alias("n")).first()
    if not info["n"]:
        raise FileError("empty")
    if info["n"] > MAX_BYTES:
        raise FileError("too large")
    head = files.select(F.substring("content", 1, HEAD).alias("h")).first()["h"]
    charset, sep = sniff(bytes(head), suffix)
    if charset != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, sep=sep, encoding=charset, header=True, inferSchema=False, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return checked(df.withColumn("row_idx", F.monotonically_increasing_id()))


def checked(df: DataFrame) -> DataFrame:
    cols = [c for c in df.columns if c != "row_idx"]
    q = lambda c: F.col(f"`{c}`")
    df = df.na.drop("all", subset=cols)
    filled = df.agg(F.count("*").alias("_rows"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    cols = [c for i, c in enumerate(cols) if filled[f"c{i}"]]
    n = filled["_rows"]
    if not n or not cols:
        raise FileError("no rows")
    if n > MAX_ROWS or len(cols) > MAX_COLUMNS or n * len(cols) > MAX_CELLS:
        raise FileError("too many rows or columns")
    return df.select("row_idx", *[q(c) for c in cols])
