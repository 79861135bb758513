"""Recognition of images by an external provider: retries, circuit breaker and deadline per partition."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

RETRY_STATUS = {408, 429, 500, 502, 503, 504}


class ProviderError(Exception):
    def __init__(self, status: int | None = None, retry_after: float | None = None):
        super().__init__(status)
        self.status, self.retry_after = status, retry_after


def delay(attempt: int, retry_after: float | None) -> float:
    return max(0.25, min(retry_after, 10.0) if retry_after is not None else 0.75 * 2**attempt)


def recognise(items: DataFrame, call: Callable[[str, bytes], str], retries: int = 1, trip: int = 3, deadline: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``idx, filename, payload, error_code`` for rows ``idx, filename, content``; the order is kept by ``idx``.

    After ``trip`` provider errors in a row the rest of the partition is ``circuit_open``; after
    ``deadline`` seconds it is ``batch_timeout``. Other failures of a row are ``worker_error``.
    """
    retries, deadline = min(4, max(0, retries)), min(900.0, max(30.0, deadline))

    def one(name: str, data: bytes) -> tuple[str | None, str | None]:
        for attempt in range(retries + 1):
            try:
                return call(name, data), None
            except ProviderError as e:
                if e.status not in RETRY_STATUS or attempt == retries:
                    return None, "provider_error"
                sleep(delay(attempt, e.retry_after))
            except Exception:
                return None, "worker_error"
        return None, "provider_error"

    def run(it):
        began, failed = time.monotonic(), 0
        for df in it:
            out = []
            for i, name, data in zip(df["idx"], df["filename"], df["content"], strict=True):
                if failed >= trip:
                    payload, code = None, "circuit_open"
                elif time.monotonic() - began > deadline:
                    payload, code = None, "batch_timeout"
                else:
                    payload, code = one(name, bytes(data) if data is not None else b"")
                    failed = failed + 1 if code == "provider_error" else 0
                out.append((i, name, payload, code))
            yield pd.DataFrame(out, columns=["idx", "filename", "payload", "error_code"])

    return items.select("idx", "filename", "content").mapInPandas(run, "idx bigint, filename string, payload string, error_code string")
