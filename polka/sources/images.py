"""Uploaded images: names, formats and sizes from their headers, direct or inside archives."""

from __future__ import annotations

import io
import re
import struct
import unicodedata
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_PIXELS, MAX_IMAGES, MAX_TOTAL = 12 * 2**20, 25_000_000, 50, 75 * 2**20
SUFFIXES = (".jpg", ".jpeg", ".png")


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) of a PNG or JPEG from its header; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                return None
            kind, n = data[i + 1], struct.unpack(">H", data[i + 2 : i + 4])[0]
            if kind in {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}:
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return "jpeg", w, h
            i += 2 + n
    return None


def image_problem(data: bytes) -> str | None:
    if not data or len(data) > MAX_BYTES:
        return "bytes"
    size = image_size(data)
    if size is None:
        return "format"
    return "pixels" if not size[1] or not size[2] or size[1] * size[2] > MAX_PIXELS else None


def safe_name(name: str, fallback: str = "photo") -> str:
    """Last path part without control characters, the stem at most 100 characters, the suffix in lower case."""
    base = unicodedata.normalize("NFKC", name or "").replace("\\", "/").rsplit("/", 1)[-1]
    base = "".join(ch for ch in base if unicodedata.category(ch)[0] != "C").strip(" .")
    stem, dot, suffix = base.rpartition(".")
    if not dot:
        stem, suffix = base, ""
    return (stem[:100] or fallback) + (f".{suffix.lower()}" if suffix else "")


def unique_names(names: list[str]) -> list[str]:
    """``_2``, ``_3`` and so on for names that are taken, ignoring letter case."""
    used, out = set(), []
    for n in names:
        stem, dot, suffix = n.rpartition(".")
        if not dot:
            stem, suffix = n, ""
        new, k = n, 1
        while new.lower() in used:
            k += 1
            new = f"{stem}_{k}{dot}{suffix}"
        used.add(new.lower())
        out.append(new)
    return out


def collect_images(files: DataFrame) -> DataFrame:
    """``path, member, name, format, width, height, size, sha256, problem`` of images in ``binaryFile`` rows.

    Images inside archives are read in memory, never unpacked to disk; folders and other
    members are skipped. ``problem`` is NULL for a sound image. The hash tells later whether
    the content is still the one that was checked.
    """

    def run(it):
        import hashlib

        from polka.sources.spreadsheet import MAX_RATIO, zip_problem

        cols = ["path", "member", "name", "format", "width", "height", "size", "sha256", "problem"]
        for df in it:
            rows = []
            for path, data in zip(df["path"], df["content"], strict=True):
                data, found = bytes(data), []
                if path.lower().endswith(".zip"):
                    problem = zip_problem(data, members=500, ratio=MAX_RATIO)
                    if problem:
                        rows.append((path, None, safe_name(path), None, None, None, len(data), None, problem))
                        continue
                    z = zipfile.ZipFile(io.BytesIO(data))
                    found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(SUFFIXES)]
                elif re.search(r"\.(?:jpe?g|png)$", path.lower()):
                    found = [(None, data)]
                for member, body in found:
                    s = image_size(body) or (None, None, None)
                    rows.append((path, member, safe_name(member or path), *s, len(body), hashlib.sha256(body).hexdigest(), image_problem(body)))
            yield pd.DataFrame(rows, columns=cols).astype({"width": "Int64", "height": "Int64", "size": "Int64"})

    return files.select("path", F.col("content")).mapInPandas(run, "path string, member string, name string, format string, width bigint, height bigint, size bigint, sha256 string, problem string")
