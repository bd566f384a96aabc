"""Feeds behind the data source interface, with an offline stand-in for the network."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ArticleFeed(DataSource):
    """Articles of a date range: ``format("article_feed").option("path", ndjson).option("start", ...)``.

    The rows come from JSON lines, where a network client would be: a folder of ``day=YYYY-MM-DD``
    folders gives a partition a day, which reads only its own; a single file is read once, by one.
    At most ``max_results`` come for each day, as one request a day would give.
    """

    @classmethod
    def name(cls) -> str:
        return "article_feed"

    def schema(self) -> str:
        return "pubmed_id string, title string, publication_date string, authors string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ArticleReader(self.options)


class _Day(InputPartition):
    def __init__(self, day: str) -> None:
        super().__init__(day)
        self.day = day


class _ArticleReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.term, self.most = options["path"], options.get("term", "").lower(), int(options.get("max_results", "500"))
        self.start, self.end = options["start"], options["end"]

    def partitions(self) -> list[InputPartition]:
        from datetime import date, timedelta

        if not os.path.isdir(self.path):
            return [_Day("")]
        first, last = date.fromisoformat(self.start), date.fromisoformat(self.end)
        days = ((first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1))
        return [_Day(day) for day in days if os.path.isdir(f"{self.path}/day={day}")]

    def read(self, partition: _Day) -> Iterator[tuple]:
        sent: Counter[str] = Counter()
        for row in _json_lines(f"{self.path}/day={partition.day}" if partition.day else self.path):
            day = partition.day or row.get("publication_date") or ""
            if self.start <= day <= self.end and self.term in (row.get("title") or "").lower() and sent[day] < self.most:
                sent[day] += 1
                yield row.get("pubmed_id"), row.get("title"), day, row.get("authors")


def _json_lines(path: str) -> Iterator[dict]:
    """Rows of a file of JSON lines, or of all such files in a folder."""
    files = sorted(f"{path}/{name}" for name in os.listdir(path) if name.endswith("json")) if os.path.isdir(path) else [path]
    for name in files:
        with open(name, encoding="utf-8") as lines:
            for line in lines:
                yield json.loads(line)


class _Text(HTMLParser):
    """The text of a page without markup, scripts, styles and its head."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in _HIDDEN and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


_HIDDEN = ("head", "script", "style")


def page_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


class PageFeed(DataSource):
    """Pages by title, as text or HTML, from a file or folder of JSON lines with ``title, html``; a partition a file."""

    @classmethod
    def name(cls) -> str:
        return "page_feed"

    def schema(self) -> str:
        return "title string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.form = options["path"], options.get("extract", "text")

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [InputPartition(f"{self.path}/{name}") for name in sorted(os.listdir(self.path)) if name.endswith("json")]
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in _json_lines(partition.value):
            body = row.get("html") or ""
            yield row.get("title"), body if self.form == "html" else page_text(body)


def register_feeds(spark: SparkSession) -> None:
    spark.dataSource.register(ArticleFeed)
    spark.dataSource.register(PageFeed)
