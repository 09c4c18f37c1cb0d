"""Paged files as a Spark data source: a partition is a range of pages of a file, not a file.

    spark.dataSource.register(paged_source(reader))
    spark.read.format("paged").load(folder)          # or spark.readStream

Files are only listed to plan a read; how many pages one has is found by the
task that opens it. A large file is dealt to several tasks by shares of its
pages, at most `SHARES`, small ones are put together.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, page_no int, blk_no int, text string, page_count int, encrypted boolean, metadata map<string,string>, error string, file_size long"

#: A share's task goes through the whole file to count its pages, so a file has so many shares at most, however large it is.
SHARES = 8
#: Bytes of a text that are read at once.
STRETCH = 1 << 20


class Pages(Protocol):
    """An open file: how many pages it has, what is said of it, and the layout blocks of one page, from 0."""

    count: int
    encrypted: bool
    metadata: dict[str, str]

    def page(self, i: int) -> list[str]: ...

    def close(self) -> None: ...


class MuPages:
    """A PDF with PyMuPDF, where that is installed."""

    def __init__(self, content: io.RawIOBase):
        import fitz

        self._doc = fitz.open(stream=content.read(), filetype="pdf")
        self.count, self.encrypted = len(self._doc), bool(self._doc.is_encrypted)
        self.metadata = {k: str(v) for k, v in (self._doc.metadata or {}).items() if v is not None}

    def page(self, i: int) -> list[str]:
        return [block[4] for block in self._doc[i].get_text("blocks")]

    def close(self) -> None:
        self._doc.close()


class TextPages:
    """A text in UTF-8 with form feeds between its pages, as converters of PDF files write it; a line is a block.

    A page that isn't UTF-8 can't be read, nor can a file that is a PDF itself.
    One pass counts the pages; then a page is read from the stretch of bytes
    that it begins in, so a page and a stretch are held, never a file.
    """

    encrypted = False

    def __init__(self, content: io.RawIOBase):
        self._content, self._starts, self._before, size = content, [], [0], 0
        while data := content.read(STRETCH):
            if not size and data.startswith(b"%PDF"):
                raise ValueError("a PDF file, not its text")
            self._starts.append(size)
            self._before.append(self._before[-1] + data.count(b"\f"))
            size += len(data)
        self.count, self.metadata = self._before[-1] + 1 if size else 0, {"format": "text"}
        self._next, self._rest = -1, iter(())

    def _from(self, start: int) -> Iterator[bytes]:
        """Pages from byte `start` on; the first is what is left of it there."""
        self._content.seek(start)
        parts: list[bytes] = []
        while data := self._content.read(STRETCH):
            *ends, rest = data.split(b"\f")
            for end in ends:
                yield b"".join([*parts, end])
                parts = []
            parts.append(rest)
        yield b"".join(parts)

    def page(self, i: int) -> list[str]:
        if i != self._next:
            k = max(bisect_left(self._before, i) - 1, 0)
            self._rest = islice(self._from(self._starts[k]), i - self._before[k], None)
        self._next = i + 1
        data = next(self._rest)
        return data.decode().split("\n") if data else []

    def close(self) -> None:
        self._rest = iter(())


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    changed: int


@dataclass
class Share(InputPartition):
    """Some files' shares: (file, share, shares)."""

    parts: tuple[tuple[Found, int, int], ...]


def _system(path: str):
    """The file system of `path` and its path there: a local path, or a URI that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def listed(path: str, glob: str) -> list[Found]:
    """Files at or below `path` whose name matches, in order of change and name."""
    from pyarrow import fs

    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else ""
    own = [i for i in infos if i.type == fs.FileType.File and not posixpath.basename(i.path).startswith(("_", ".")) and fnmatch.fnmatch(posixpath.basename(i.path), glob)]
    return sorted((Found(prefix + i.path, i.size or 0, i.mtime_ns or 0) for i in own), key=lambda f: (f.changed, f.path))


def dealt(files: list[Found], split_bytes: int) -> list[Share]:
    """Shares of large files, each by itself, and small files together, of some `split_bytes` bytes; more where a file would have over `SHARES`."""
    out, some, size = [], [], 0
    for f in files:
        shares = min(max(1, -(-f.size // split_bytes)), SHARES)
        if shares > 1:
            out += [Share(((f, k, shares),)) for k in range(shares)]
            continue
        if some and size + f.size > split_bytes:
            out.append(Share(tuple(some)))
            some, size = [], 0
        some.append((f, 0, 1))
        size += f.size
    return out + ([Share(tuple(some))] if some else [])


def _says(doc: Pages, i: int) -> bool:
    """Whether a page gives rows: blocks, or the error of one that can't be read."""
    try:
        return bool(doc.page(i))
    except Exception:
        return True


def rows_of(share: Share, opened) -> Iterator[tuple]:
    """Rows of a partition. A page that can't be read is one row with its error; so is a file, with page 0.

    A file without a block is one row of page 0 without text, so each file has
    a row: from its first share, which looks at later pages if its own are blank.
    """
    for f, k, shares in share.parts:
        system, inner = _system(f.path)
        try:
            with system.open_input_file(inner) as content:
                doc = opened(content)
                about = (doc.count, doc.encrypted, doc.metadata)
                try:
                    empty = True
                    for i in range(doc.count * k // shares, doc.count * (k + 1) // shares):
                        try:
                            blocks = doc.page(i)
                        except Exception as e:  # the page is left out, the file goes on
                            yield (f.path, i + 1, 0, None, *about, str(e), f.size)
                            empty = False
                            continue
                        for n, text in enumerate(blocks):
                            yield (f.path, i + 1, n, text, *about, None, f.size)
                            empty = False
                    if empty and k == 0 and not any(_says(doc, i) for i in range(doc.count // shares, doc.count)):
                        yield (f.path, 0, 0, None, *about, None, f.size)
                finally:
                    doc.close()
        except Exception as e:
            if k == 0:
                yield (f.path, 0, 0, None, None, None, None, str(e), f.size)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, opened):
        self.path, self.glob, self.split = options["path"], options.get("pathglobfilter", "*"), int(options.get("splitbytes", 8 << 20))
        self.opened = opened

    def partitions(self) -> list[Share]:
        return dealt(listed(self.path, self.glob), self.split) or [Share(())]

    def read(self, partition: Share) -> Iterator[tuple]:
        return rows_of(partition, self.opened)


class _StreamReader(DataSourceStreamReader):
    """Files as they arrive. An offset is the time of change and name up to which files were read; at most `maxFilesPerTrigger` go in a batch."""

    def __init__(self, options: dict, opened):
        self.path, self.glob, self.split = options["path"], options.get("pathglobfilter", "*"), int(options.get("splitbytes", 8 << 20))
        self.most, self.opened = int(options.get("maxfilespertrigger", 1000)), opened
        self.at: tuple[int, str] | None = None

    def _files(self, after: tuple[int, str], upto: tuple[int, str] | None = None) -> list[Found]:
        return [f for f in listed(self.path, self.glob) if (f.changed, f.path) > after and (upto is None or (f.changed, f.path) <= upto)]

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        new = self._files(self.at or (-1, ""))[: self.most]
        if new:
            self.at = new[-1].changed, new[-1].path
        at = self.at or (-1, "")
        return {"changed": at[0], "path": at[1]}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        upto = end["changed"], end["path"]
        self.at = max(self.at or upto, upto)  # after a restart, what the checkpoint says was planned
        return dealt(self._files((start["changed"], start["path"]), upto), self.split)

    def read(self, partition: Share) -> Iterator[tuple]:
        return rows_of(partition, self.opened)

    def commit(self, end: dict) -> None:
        pass


def paged_source(opened=MuPages, name: str = "paged") -> type[DataSource]:
    """A data source of files that `opened` reads: it takes a binary file and gives an open one (`Pages`).

    Options: `path`, `pathGlobFilter`, `splitBytes` (bytes of a file to a
    task, 8 MB by default, more for files of over `SHARES` times that), and for streams `maxFilesPerTrigger`.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _options(self) -> dict:
            return {k.lower(): v for k, v in self.options.items()}

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self._options(), opened)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(self._options(), opened)

    return Paged
