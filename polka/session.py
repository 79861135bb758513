"""Session helpers: reading tables, cutting lineage, checked broadcasts, salted joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where it is unset a local session (one machine, as in tests) gets a temporary folder; on a cluster, whose
    executors could not read that, this raises ``RuntimeError``.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="polka-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Shuffle files go when the query that wrote them has ended, not when the driver happens to collect its garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    Unlike ``checkpoint()`` the rows are computed once, stay columnar, and later
    scans prune columns. The files survive the loss of any executor. The shuffle files that
    led to them are deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def no_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins of what is planned inside are of shuffled sides, unless a hint says otherwise; the former settings come back.

    The planner knows the size of compressed files and of the rows before an explode, so what it takes for small enough to
    be collected by the driver may be many times larger. What is planned must be run inside too (:func:`cut`).
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_of: Column, salts: int = 16, how: str = "inner", broadcast: bool = True) -> DataFrame:
    """Equi-join where one key may hold a third of ``big``.

    ``small`` (few rows per key) is repeated once per salt, ``big`` is spread over
    the salts by ``salt_of``, so a hot key is met by ``salts`` tasks. Without ``broadcast`` (for a ``small`` that
    grows with the data) both sides are shuffled: the planner knows the size of files, not that of rows repeated per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if not broadcast:
        right = right.hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
