"""A data source of books: the EPUB, HTML and text files below a folder as a table of pages, read at once or as a stream.

    spark.dataSource.register(Books)
    spark.read.format("quillspark_books").load(folder)                              # a row per page
    spark.read.format("quillspark_books").option("rows", "files").load(folder)      # a row per file, none is opened
    spark.readStream.format("quillspark_books").load(folder)                        # pages of files as they arrive

The schema asked for says how much is read: without raw and error no chapter is unpacked, only the order of the chapters;
files in rows of their own are opened for title and author alone. A task reads files of about `split` bytes, one chapter
at a time; of a larger book several tasks read every so manyth chapter each. Folders are whatever pyarrow opens: local
and mounted paths, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quillspark.sources import files

FILE = "path string, size long, mtime double, title string, author string"
PAGE = FILE + ", page_num int, raw string, error string"
ENDINGS = (".epub", ".html", ".htm", ".xhtml", ".txt")
#: Bytes of files that a task reads, unless the option split says otherwise.
SPLIT = 32 << 20


@dataclass
class Part(InputPartition):
    """Files (path, size, mtime in ns) of one task; of them every `of`-th chapter from `first` on."""

    found: list
    first: int = 0
    of: int = 1

    def __post_init__(self):
        super().__init__(None)


class Folder:
    """The files of a folder, and how to open one."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def _opened(self):
        from pyarrow import fs

        if self.base.startswith("file:") or "://" not in self.base:
            return fs.LocalFileSystem(), posixpath.abspath(self.base.removeprefix("file://").removeprefix("file:"))
        return fs.FileSystem.from_uri(self.base)

    def listing(self) -> list[tuple[str, int, int]]:
        """(path, size, mtime in ns) of the books, by path; hidden files and folders are left out."""
        from pyarrow import fs

        system, root = self._opened()
        out = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            inner = f.path[len(root) :].lstrip("/")
            hidden = any(p.startswith((".", "_")) for p in inner.split("/"))
            if f.type == fs.FileType.File and not hidden and inner.lower().endswith(ENDINGS):
                out.append((f"{self.base}/{inner}", f.size or 0, f.mtime_ns or 0))
        return sorted(out)

    @contextmanager
    def open(self, path: str):
        system, root = self._opened()
        with system.open_input_file(posixpath.join(root, path[len(self.base) :].lstrip("/"))) as f:
            yield f


def dealt(found: list, split: int, whole: bool) -> list[Part]:
    """Parts of about split bytes: small files together, a larger book in several (not if only whole files are asked for)."""
    out, some, held = [], [], 0
    for f in found:
        n = -(-f[1] // split) if f[0].lower().endswith(".epub") and not whole else 1
        if n > 1:
            out += [Part([f], k, n) for k in range(n)]
            continue
        if some and held + f[1] > split:
            out, some, held = [*out, Part(some)], [], 0
        some.append(f)
        held += f[1]
    return [*out, Part(some)] if some else out


class Pages:
    """What both readers share: a part's rows in the columns asked for."""

    def __init__(self, schema: StructType, options: dict):
        if not options.get("path"):
            raise ValueError("say which folder: load(folder)")
        self.columns = [f.name for f in schema.fields]
        unknown = set(self.columns) - {c.split()[0] for c in PAGE.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.folder = Folder(options["path"])
        self.split = int(options.get("split", SPLIT))
        self.whole = options.get("rows", "pages") == "files"
        if self.split < 1 or options.get("rows", "pages") not in ("pages", "files"):
            raise ValueError("split is a positive number; rows are pages or files")

    def rows(self, part: Part) -> Iterator[tuple]:
        for path, size, mtime in part.found:
            about = {"path": path, "size": size, "mtime": mtime / 1e9}
            for more in self._file(path, part) if self._opens() else [{}]:
                row = about | more
                yield tuple(row.get(c) for c in self.columns)

    def _opens(self) -> bool:
        return not self.whole or bool({"title", "author"} & {*self.columns})

    def _file(self, path: str, part: Part) -> Iterator[dict]:
        """The rows of one file; one that is broken, gone or closed to us is a page with an error, of its first part. Other
        errors of reading are the task's, which Spark tries again."""
        read = bool({"raw", "error"} & {*self.columns}) and not self.whole
        try:
            if not path.lower().endswith(".epub"):
                raw = None
                if read:
                    with self.folder.open(path) as f:
                        raw = f.read().decode("utf-8", "replace")
                yield {"page_num": 1, "raw": raw}
                return
            with self.folder.open(path) as f, zipfile.ZipFile(f) as z:
                about = files.book_metadata(z) if {"title", "author"} & {*self.columns} else {}
                if self.whole:
                    yield about
                    return
                for i, (raw, error) in enumerate(files.book_chapters(z, read, part.first, part.of)):
                    yield about | {"page_num": part.first + i * part.of + 1, "raw": raw, "error": error}
        except (FileNotFoundError, PermissionError, zipfile.BadZipFile, ValueError) as e:  # pyarrow's errors of position are ValueErrors
            if part.first == 0:
                yield {"page_num": 1, "raw": "", "error": str(e)}


class BookReader(Pages, DataSourceReader):
    def partitions(self) -> list[Part]:
        return dealt(self.folder.listing(), self.split, self.whole) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.rows(partition)


class BookStream(Pages, DataSourceStreamReader):
    """Files by time, those of one time by path; an offset is the last time and the files that had it. A changed file has a
    later time and comes again. One put in with an earlier time than the last one's is not seen: move or touch it."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mtime": -1, "paths": []}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self.folder.listing()
        last = max((m for _, _, m in found), default=-1)
        return {"mtime": last, "paths": [p for p, _, m in found if m == last]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        upto = lambda f, o: f[2] < o["mtime"] or (f[2] == o["mtime"] and f[0] in o["paths"])
        return dealt([f for f in self.folder.listing() if upto(f, end) and not upto(f, start)], self.split, self.whole)

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Books(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillspark_books"

    def schema(self) -> str:
        return FILE if self.options.get("rows") == "files" else PAGE

    def reader(self, schema: StructType) -> BookReader:
        return BookReader(schema, self.options)

    def streamReader(self, schema: StructType) -> BookStream:  # noqa: N802
        return BookStream(schema, self.options)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime) of the books, such as index.scan_plan takes; none is opened."""
    spark.dataSource.register(Books)
    return spark.read.format(Books.name()).schema("path string, size long, mtime double").option("rows", "files").load(folder)


def pages(spark: SparkSession, folder: str, keep_empty: bool = True, split: int = SPLIT) -> DataFrame:
    """Pages as files.pages() gives them, with the titles that the books themselves name, and author, size and mtime."""
    spark.dataSource.register(Books)
    return files.with_text(spark.read.format(Books.name()).option("split", split).load(folder), keep_empty)


def page_stream(spark: SparkSession, folder: str, keep_empty: bool = True) -> DataFrame:
    """The same as a stream; streaming.ingest keeps its latest rows of each page."""
    spark.dataSource.register(Books)
    return files.with_text(spark.readStream.format(Books.name()).load(folder), keep_empty)
