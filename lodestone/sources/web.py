"""Fetching pages, only when asked to."""

from __future__ import annotations

import functools
import urllib.request
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.services import Caller, Manners, host_of


def _page(url: str, timeout: float, most: int) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        body = answer.read(most + 1)
        if len(body) > most:
            raise ValueError(f"over {most} bytes")
        return body.decode(answer.headers.get_content_charset() or "utf-8", "replace")


def _fetch(batches: Iterable[pa.RecordBatch], timeout: float, most: int, manners: Manners) -> Iterator[pa.RecordBatch]:
    caller = Caller(manners)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            urls = batch.column(0).slice(at, 256).to_pylist()
            found = caller.all(functools.partial(_page, timeout=timeout, most=most), urls, host_of)
            errors = [None if e is None else (str(e) or type(e).__name__) for _, e in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (urls, [html for html, _ in found], errors)], names=["url", "html", "error"])


def fetch_pages(urls: DataFrame, *, timeout: float = 30, most_bytes: int = 64 << 20, manners: Manners | None = None) -> DataFrame:
    """Rows (url) to (url, html, error). A page that fails after all tries, or that the server answers with an error, has no html and says why.

    URLs of one host come to one task, which is how fast a host is asked: at most `per_host` requests at once, `pause` seconds apart.
    """
    dealt = urls.select("url").repartition(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return dealt.mapInArrow(functools.partial(_fetch, timeout=timeout, most=most_bytes, manners=manners or Manners(per_host=2)), "url string, html string, error string")
