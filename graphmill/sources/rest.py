"""A paged REST API as a Spark data source.

Pages are read until one is shorter than the page size. Too many requests and server errors are tried again with
growing pauses; 401 fails at once. Each resource is one input partition, so several resources load in parallel.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY = frozenset((403, 429, 500, 502, 503, 504))
Fetch = Callable[[str], tuple[int, str]]


def http_fetch(url: str) -> tuple[int, str]:
    """(status, body) of a GET."""
    try:
        with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310 - the address is the user's
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch_with_retry(url: str, fetch: Fetch, tries: int = 5, pause: float = 1.0) -> list:
    """The JSON list of a page; PermissionError on 401, ConnectionError when all tries fail."""
    for n in range(tries):
        status, body = fetch(url)
        if status == 200:
            return json.loads(body)
        if status == 401:
            raise PermissionError(url)
        if status not in RETRY:
            raise ConnectionError(f"{status} for {url}")
        if n + 1 < tries:
            time.sleep(pause * 2**n)
    raise ConnectionError(f"no answer from {url}")


def pages(base: str, size: int, fetch: Fetch, pause: float = 1.0) -> Iterator[dict]:
    """Records of all pages."""
    page = 1
    while True:
        sign = "&" if "?" in base else "?"
        rows = fetch_with_retry(f"{base}{sign}per_page={size}&page={page}", fetch, pause=pause)
        yield from rows
        if len(rows) < size:
            return
        page += 1


class _Part(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(u) for u in self.options["path"].split(",")]

    def read(self, partition: _Part) -> Iterator[tuple[str, str]]:
        folder = self.options.get("stub")  # pages as files, for tests: <folder>/<page>.json

        def stub(url: str) -> tuple[int, str]:
            page = url.rsplit("page=", 1)[-1]
            try:
                with open(f"{folder}/{page}.json") as f:
                    return 200, f.read()
            except OSError:
                return 200, "[]"

        for row in pages(partition.url, int(self.options.get("per_page", 100)), stub if folder else http_fetch):
            yield partition.url, json.dumps(row)


class RestSource(DataSource):
    """Format ``graphmill_rest``: option path (comma separated addresses), per_page. Columns: resource, record (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "graphmill_rest"

    def schema(self) -> str:
        return "resource string, record string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options)
