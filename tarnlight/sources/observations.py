"""A data source of HTTP observations: each partition fetches its share of the addresses with retries.

Live fetching needs a network; a `fetcher` may be any function of (url, method) to (status, headers,
body), so tests and replays use their own.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRY_STATUS = frozenset((429, 500, 502, 503, 504))
SCHEMA = "site string, url string, path string, method string, status int, headers map<string,string>, body string, error string"


def http_fetch(url: str, method: str, timeout: float = 15.0) -> tuple[int, dict[str, str], str]:
    request = urllib.request.Request(url, method=method)
    with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
        return r.status, dict(r.headers), r.read().decode("utf-8", "replace")


def with_retry(fetch: Callable, url: str, method: str, retries: int = 3, base: float = 1.0, most: float = 30.0) -> tuple[int | None, dict, str | None, str | None]:
    """Up to `retries` further attempts with doubling pauses; the last failure becomes the error."""
    status, headers, body, error = None, {}, None, None
    for attempt in range(retries + 1):
        try:
            status, headers, body = fetch(url, method)
            error = None
            if status not in RETRY_STATUS:
                break
        except Exception as e:  # any failure of a fetch is data
            error = f"{type(e).__name__}: {e}"[:500]
        if attempt < retries:
            time.sleep(min(base * 2**attempt, most))
    return status, headers, body, error


def observe(probes: DataFrame, fetcher: Callable = http_fetch, retries: int = 3, pause: float = 1.0, partitions: int | None = None) -> DataFrame:
    """Observations (SCHEMA) of probes (site, url, path, method); sites are spread over the partitions by address."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                status, headers, body, error = with_retry(fetcher, r.url, r.method, retries, pause)
                rows.append((r.site, r.url, r.path, r.method, status, headers, body, error))
            yield pd.DataFrame(rows, columns=["site", "url", "path", "method", "status", "headers", "body", "error"])

    spread = probes.select("site", "url", "path", "method")
    spread = spread.repartition(partitions, F.xxhash64("url")) if partitions else spread
    return spread.mapInPandas(run, SCHEMA)
