"""A paged repository listing as a Python data source: each page is a partition.

Pages are JSON files of a folder that all executors see, or whatever ``Pages`` fetches; a host that names its next page
(``next``) is followed page by page on the driver, which holds only their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvex.errors import ApiError, AuthenticationFailed, NotFound, RateLimited

SCHEMA = "provider string, page int, position int, body string"


def check(status: int, headers: dict[str, str] | None = None, message: str = "") -> None:
    """Raises what a response's status stands for; 2xx passes. A limit without a time to wait means a minute."""
    if 200 <= status < 300:
        return
    if status == 404:
        raise NotFound("resource not found")
    if status in (401, 403):
        raise AuthenticationFailed(message or "authentication failed")
    if status == 429:
        after = {k.lower(): v for k, v in (headers or {}).items()}.get("retry-after", "")
        raise RateLimited(int(after) if after.isdigit() else 60)
    raise ApiError(status, message)


def with_retry(fetch: Callable[[], str], wait: Callable[[float], None], most: int = 3) -> str:
    """What ``fetch`` gives, after as many waits as the host asks for, ``most`` at most."""
    for attempt in range(most + 1):
        try:
            return fetch()
        except RateLimited as e:
            if attempt == most:
                raise
            wait(e.seconds)
    raise AssertionError


class Page(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.provider, self.folder = options.get("provider", "gitea"), options["path"]

    def partitions(self) -> list[InputPartition]:
        """Pages page-1.json, page-2.json, ... up to the first that is missing; where the first names a ``next`` page, as
        each page says, up to one that names none."""
        out: list[InputPartition] = []
        name, seen, linked = "page-1.json", set(), False
        while name and name not in seen and os.path.exists(path := os.path.join(self.folder, name)):
            seen.add(name)
            out.append(Page(len(out) + 1, path))
            name = f"page-{len(out) + 1}.json"
            if linked or len(out) == 1:
                with open(path, encoding="utf-8") as f:
                    page = json.load(f)
                after = os.path.basename(page.get("next") or "") if isinstance(page, dict) else ""
                linked = linked or bool(after)
                name = after if linked else name
        return out or [Page(0, "")]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            page = json.load(f)
        for i, repository in enumerate(page["values"] if isinstance(page, dict) else page):
            yield self.provider, partition.number, i, json.dumps(repository)


class Listing(DataSource):
    """``spark.dataSource.register(Listing)``; then ``spark.read.format("listing").option("provider", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)
