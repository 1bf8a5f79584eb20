"""Cursor-paged sources as a Spark data source (S01-S05): tiers of retries, three ways of paging, partitions of feeds or id ranges.

``spark.dataSource.register(PagedSource)``, then
``spark.read.format("paged").option("feeds", "a,b").option("pages", "/folder").load()`` reads ``<feed>.jsonl`` files the way a
paged service would give them: newest first, ``limit`` items a page, the next page before the oldest item so far.  Options:

* ``mode``: ``feed`` (all items of a feed, at most ``maxpages`` pages), ``threads`` (for each id in ``ids`` the items whose parent
  it is, to the last page) or ``first`` (the first page of each id only, as a service without a cursor gives it)
* ``ids``: thread ids; ``idsperpartition``: how many of them a task reads

Another transport is a subclass of ``PagedReader`` that overrides ``page``.
"""

from __future__ import annotations

import heapq
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Transient(Exception):
    """A failure that is worth another try. ``tier``: ``rate`` for a refused rate, ``server`` or ``network``."""

    def __init__(self, tier: str = "network"):
        super().__init__(tier)
        self.tier = tier


class Rejected(Exception):
    """The service knows the request to be wrong; no try follows."""


#: Of each tier the tries, and the wait before try k (from 1).
TIERS = {"rate": (5, lambda k: min(60 * 2 ** (k - 1), 600)), "server": (5, lambda k: 30), "network": (3, lambda k: 10)}


def check_status(status: int, text: str = "") -> None:
    """Raise what a status asks for: 429 and 422 are a refused rate, 400 ends it, 5xx are the server's."""
    if status in (422, 429):
        raise Transient("rate")
    if status >= 500:
        raise Transient("server")
    if status >= 400:
        raise Rejected(f"{status} {text}".strip())


def fetch_with_retry(call, *, tiers=None, sleep=time.sleep):
    """``call()`` until it gives a page; each tier counts its own tries, and the last failure of a tier is raised."""
    failed: dict[str, int] = {}
    while True:
        try:
            return call()
        except Transient as e:
            tries, wait = (tiers or TIERS)[e.tier]
            k = failed[e.tier] = failed.get(e.tier, 0) + 1
            if k >= tries:
                raise
            sleep(wait(k))


def paged(page, limit: int, max_pages: int) -> Iterator[dict]:
    """Items of ``page(before, limit)``, newest first, until a page is short or empty, or ``max_pages`` were read."""
    before = None
    for _ in range(max_pages):
        items = fetch_with_retry(lambda b=before: page(b, limit))
        yield from items
        if len(items) < limit:
            return
        before = min(int(x["created_utc"]) for x in items)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        split = lambda name: [x for x in options.get(name, "").split(",") if x]
        self.feeds, self.ids, self.mode = split("feeds"), split("ids"), options.get("mode", "feed")
        if self.mode not in ("feed", "threads", "first"):
            raise ValueError(f"no mode {self.mode}")
        self.folder, self.limit = options.get("pages", "."), int(options.get("limit", 100))
        self.max_pages = 1 if self.mode == "first" else int(options.get("maxpages", 100_000))
        self.per_partition = int(options.get("idsperpartition", 1000))

    def partitions(self):
        if self.mode == "feed":
            return [InputPartition((f, ())) for f in self.feeds]
        blocks = [tuple(self.ids[i : i + self.per_partition]) for i in range(0, len(self.ids), self.per_partition)]
        return [InputPartition((f, b)) for f in self.feeds for b in blocks]

    def _items(self, feed: str) -> Iterator[dict]:
        with open(os.path.join(self.folder, f"{feed}.jsonl"), encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    yield json.loads(line)

    def page(self, feed: str, parent: str | None, before: int | None, limit: int) -> list[dict]:
        """The newest ``limit`` items before the cursor, and those of the last one's second, so that the cursor loses none.

        The file is streamed once a page and only the page is held; ``read`` streams a whole feed once instead.
        """
        fits = lambda x: (before is None or int(x["created_utc"]) < before) and (parent is None or x.get("parent") == parent)
        part = heapq.nlargest(limit, ((int(x["created_utc"]), i, x) for i, x in enumerate(self._items(feed)) if fits(x)), key=lambda t: (t[0], -t[1]))
        if len(part) < limit:
            return [x for *_, x in part]
        last, held = part[-1][0], {i for _, i, _ in part}
        return [x for *_, x in part] + [x for i, x in enumerate(self._items(feed)) if int(x["created_utc"]) == last and i not in held and fits(x)]

    def _local(self, feed: str, parents: tuple[str, ...]) -> Iterator[dict]:
        """What the pages of a local file would give together: one pass, as long as no page is to be left out."""
        wanted = set(parents)
        for x in self._items(feed):
            if not parents or x.get("parent") in wanted:
                yield x

    def read(self, partition):
        feed, parents = partition.value
        if type(self).page is PagedReader.page and self.mode != "first" and self.max_pages >= 100_000:
            items = self._local(feed, parents)
        else:
            items = (x for p in (parents or (None,)) for x in paged(lambda before, limit, p=p: self.page(feed, p, before, limit), self.limit, self.max_pages))
        for x in items:
            yield (x.get("id"), x.get("parent"), x.get("text"), int(x["created_utc"]))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, parent string, text string, created_utc long"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
