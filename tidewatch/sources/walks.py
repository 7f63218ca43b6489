"""Walks over result pages as a streaming source whose offsets are page tokens.

``spark.dataSource.register(PageWalk)``, then ``spark.readStream.format("page_walk")`` with the options ``collector``
("module:Class"), ``sources`` (names, comma-separated), ``pages`` (at most so many a source and batch) and whatever the
collector reads.  A collector knows three things of a source: its first token, the token after one, and a token's page.

An offset holds the next token of each source.  The checkpoint keeps the offsets, so a walk that stops goes on at the
page where its last finished batch ended; a batch that failed is read again between the same tokens, no page is lost
and none comes twice.  The driver follows tokens only; pages are read by one task for each source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from importlib import import_module
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

END = ""  # the token after a walk's last page


class Collector(Protocol):
    """What a walk needs of a kind of source; made from the stream's options."""

    def first(self, source: str) -> str: ...

    def after(self, source: str, token: str) -> str: ...

    def page(self, source: str, token: str) -> str: ...


class FolderWalk:
    """Captured pages in a folder for each source below the option ``path`` (any file system Arrow knows), in order of name."""

    def __init__(self, options: dict[str, str]) -> None:
        from pyarrow import fs

        where = options["path"]
        self.files, self.root = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)

    def _next(self, source: str, token: str) -> str:
        from pyarrow import fs

        names = (f.base_name for f in self.files.get_file_info(fs.FileSelector(f"{self.root}/{source}")))
        return min((n for n in names if n > token), default=END)

    def first(self, source: str) -> str:
        return self._next(source, "")

    def after(self, source: str, token: str) -> str:
        return self._next(source, token)

    def page(self, source: str, token: str) -> str:
        with self.files.open_input_stream(f"{self.root}/{source}/{token}") as held:
            return held.read().decode("utf-8", errors="replace")


def collector(options: dict[str, str]) -> Collector:
    module, _, name = options["collector"].partition(":")
    return getattr(import_module(module), name)(options)


class Stretch(InputPartition):
    """Pages of one source that a task reads."""

    def __init__(self, source: str, tokens: list[str]) -> None:
        self.source, self.tokens = source, tokens


class WalkReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.sources = sorted({s.strip() for s in options["sources"].split(",") if s.strip()})
        self.most = int(options.get("pages", "20"))
        self.at: dict[str, str] | None = None  # where the latest planned batch ends

    def initialOffset(self) -> dict[str, str]:
        walks = collector(self.options)
        return {s: walks.first(s) for s in self.sources}

    def latestOffset(self) -> dict[str, str]:
        """Each walk ``pages`` tokens on; one that has ended stays where it is."""
        walks, now = collector(self.options), self.at if self.at is not None else self.initialOffset()
        then = {}
        for source, token in now.items():
            for _ in range(self.most):
                token = token and walks.after(source, token)
            then[source] = token
        self.at = then
        return then

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> Sequence[Stretch]:
        if self.at is None:  # after a restart the engine plans its last batch first
            self.at = end
        walks, found = collector(self.options), []
        for source, token in start.items():
            tokens = []
            while token and token != end[source]:
                tokens.append(token)
                token = walks.after(source, token)
            if tokens:
                found.append(Stretch(source, tokens))
        return found

    def read(self, partition: Stretch) -> Iterator[tuple[str, str, str]]:
        walks = collector(self.options)
        for token in partition.tokens:
            yield partition.source, token, walks.page(partition.source, token)


class PageWalk(DataSource):
    """``source``, ``token``, ``html`` of every page of the walks."""

    @classmethod
    def name(cls) -> str:
        return "page_walk"

    def schema(self) -> str:
        return "source string, token string, html string"

    def streamReader(self, schema) -> WalkReader:
        return WalkReader(self.options)
