"""Which function makes tickets of a sportsbook's pages, and a source that reads pages from files, at once or as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import pages as book_pages
from .shared import written

# ---- books


@dataclass(frozen=True)
class Parser:
    """tickets: from the cards of pages (pages.cards) to tickets with page_id."""

    tickets: Callable[[DataFrame], DataFrame] | None
    enabled: bool = True
    status: str = "implemented"


#: Books by name. One that isn't enabled is known, but its pages are not read.
PARSERS = {"FanDuel": Parser(book_pages.fanduel_tickets), "DraftKings": Parser(book_pages.draftkings_tickets), "Other": Parser(None, False, "disabled")}
#: What tickets of all books have.
COMMON = ["page_id", "id", "book", "bet_id", "placed_at", "bet_type", "odds", "stake", "payout", "result"]


def enabled(parsers: dict[str, Parser] | None = None) -> list[str]:
    return sorted(n for n, p in (PARSERS if parsers is None else parsers).items() if p.enabled and p.tickets)


def parse(pages: DataFrame, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tickets of all books by their common columns, page_id and error_code of each page).

    pages: page_id, book, html. A page is read once: its cards are stored before the book's function sees them.
    """
    parsers = PARSERS if parsers is None else parsers
    routed = book_pages.route(pages, enabled(parsers))
    found = written(book_pages.cards(routed.where("error_code IS NULL")), "page-cards")
    tickets = None
    for name in enabled(parsers):
        mine = parsers[name].tickets(found.where(F.col("book") == name)).select(*COMMON)
        tickets = mine if tickets is None else tickets.unionByName(mine)
    if tickets is None:
        raise ValueError("no book is enabled")
    tickets = written(tickets, "page-tickets")
    return tickets, book_pages.without_tickets(routed, tickets, found).select("page_id", "error_code")


# ---- pages from files


@dataclass
class Files(InputPartition):
    """Files of one task: (path, size, time of change in nanoseconds)."""

    files: list[tuple[str, int, int]]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def listed(path: str) -> list[tuple[str, int, int]]:
    """The pages below a folder, oldest first."""
    fs, at = _open(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(((f.path, f.size, f.mtime_ns) for f in found if f.is_file and f.extension in ("html", "htm")), key=lambda f: (f[2], f[0]))


def packed(files: list[tuple[str, int, int]], size: int) -> list[Files]:
    """Files in tasks of about `size` bytes each."""
    out, held = [], 0
    for f in files:
        if not out or held + f[1] > size:
            out.append(Files([]))
            held = 0
        out[-1].files.append(f)
        held += f[1]
    return out


class _Pages:
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("taskBytes", 32 << 20))

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        for path, _, changed in partition.files:
            with fs.open_input_stream(path) as f:
                html = f.read().decode("utf-8", "replace")
            number = int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "big", signed=True)
            yield number, path, path.rsplit("/", 2)[-2], datetime.fromtimestamp(changed / 1e9, timezone.utc), html


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Files]:
        return packed(listed(self.path), self.size) or [Files([])]


class _Stream(_Pages, DataSourceStreamReader):
    """An offset is the time and path of the last page read: pages that come later, or change, are read then."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"time": files[-1][2], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        return packed([f for f in listed(self.path) if lo < (f[2], f[0]) <= hi], self.size) or [Files([])]

    def commit(self, end: dict) -> None:
        pass


class PageFiles(DataSource):
    """`betting_pages`: HTML files below `path`, each in a folder named like its book. Option taskBytes: bytes a task reads (32 MB).

    The folder is read by pyarrow's file systems, so it has to be one that they know and all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "betting_pages"

    def schema(self) -> str:
        return "page_id long, path string, book string, changed timestamp, html string"

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)
