"""Sources and sinks: EPUB, HTML, PDF and text files, thesaurus files, exports."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import file_type, heading, html_heading, html_to_text, title_from_path, year_guess
from quillspark.plans.query import Thesaurus

PAGES = "path string, page_num int, raw string, error string"


def listing(spark: SparkSession, folder: str, pattern: str = "*.{pdf,epub,html,txt}") -> DataFrame:
    """(path, size, mtime, content) of the files below folder. Without the column content no file is opened."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return x.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("mtime"), "content")


def _package(z: zipfile.ZipFile) -> tuple[ElementTree.Element | None, str]:
    """A book's package document and its folder; None without one that can be read."""
    try:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        path = box.find(".//{*}rootfile").get("full-path")
        return ElementTree.fromstring(z.read(path)), posixpath.dirname(path)
    except Exception:  # noqa: BLE001
        return None, ""


def _reading_order(z: zipfile.ZipFile) -> list[str]:
    """Chapter files as the package's spine orders them, then those that it does not name, by name."""
    package, folder = _package(z)
    spine: list[str] = []
    if package is not None:
        href = {i.get("id"): i.get("href") for i in package.findall(".//{*}manifest/{*}item")}
        named = [href.get(i.get("idref")) for i in package.findall(".//{*}spine/{*}itemref")]
        spine = [posixpath.normpath(posixpath.join(folder, unquote(n))) for n in named if n]
    rest = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
    return list(dict.fromkeys(spine + rest))


def book_chapters(z: zipfile.ZipFile, read: bool = True, first: int = 0, of: int = 1) -> Iterator[tuple[str | None, str | None]]:
    """(html, error) of every `of`-th chapter file in reading order, from `first` on, one at a time; a broken or missing
    chapter has an error, not the book. read: else nothing is unpacked and both are null."""
    for name in _reading_order(z)[first::of]:
        if not read:
            yield None, None
            continue
        try:
            yield z.read(name).decode("utf-8"), None
        except OSError:  # of the file system, not the book
            raise
        except Exception as e:  # noqa: BLE001
            yield "", f"{name}: {e}"


def book_metadata(z: zipfile.ZipFile) -> dict[str, str]:
    """Title and author that a book's package names."""
    package, _ = _package(z)
    found = {} if package is None else {k: package.findtext(f".//{{*}}metadata/{{*}}{tag}") for k, tag in (("title", "title"), ("author", "creator"))}
    return {k: v.strip() for k, v in found.items() if v and v.strip()}


def epub_chapters(data: bytes) -> list[tuple[str, str | None]]:
    """book_chapters() of a whole book."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return list(book_chapters(z))


def epub_metadata(data: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return book_metadata(z)


def _with_pdfplumber(data: bytes) -> tuple[dict, list[tuple[str, str | None]]]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return dict(pdf.metadata or {}), _texts(pdf.pages)


def _with_pypdf(data: bytes) -> tuple[dict, list[tuple[str, str | None]]]:
    from pypdf import PdfReader

    pdf = PdfReader(io.BytesIO(data))
    return {k.lstrip("/"): v for k, v in (pdf.metadata or {}).items()}, _texts(pdf.pages)


def _texts(found) -> list[tuple[str, str | None]]:
    """(text, error) of each page; a broken page has an error, not the file."""
    out = []
    for p in found:
        try:
            out.append((p.extract_text() or "", None))
        except Exception as e:  # noqa: BLE001
            out.append(("", str(e)))
    return out


def _read_pdf(data: bytes) -> tuple[dict, list[tuple[str, str | None]]]:
    """Metadata and pages by the first reader that is installed and opens the file."""
    error = "no PDF library installed"
    for reader in (_with_pdfplumber, _with_pypdf):
        try:
            return reader(bytes(data))
        except ImportError:
            continue
        except Exception as e:  # noqa: BLE001
            error = str(e)
    return {}, [("", error)]


def pdf_pages(data: bytes) -> list[tuple[str, str | None]]:
    """(text, error) of each page, where a PDF library is installed."""
    return _read_pdf(data)[1]


def pdf_metadata(data: bytes) -> dict[str, str]:
    """Title and author that a PDF names, where a PDF library is installed."""
    meta = _read_pdf(data)[0]
    return {k: str(meta[k.title()]).strip() for k in ("title", "author") if str(meta.get(k.title()) or "").strip()}


def metadata(files: DataFrame) -> DataFrame:
    """(path, title, author) as EPUB and PDF files name them; else the title is the file's name and the author empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for path, data in zip(p["path"], p["content"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    found = epub_metadata(data) if kind == "epub" else pdf_metadata(data) if kind == "pdf" else {}
                except Exception:  # noqa: BLE001
                    found = {}
                rows.append((path, found.get("title"), found.get("author", "")))
            yield pd.DataFrame(rows, columns=["path", "title", "author"])

    x = files.select("path", "content").mapInPandas(run, "path string, title string, author string")
    return x.withColumn("title", F.coalesce("title", title_from_path(F.col("path"))))


def pages(files: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Files to pages: path, title, file_type, page_num (from 1), text, heading, year, error. A file that can't be read is
    one page with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, data in zip(p["path"], p["content"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    found = epub_chapters(data) if kind == "epub" else pdf_pages(data) if kind == "pdf" else [(bytes(data).decode("utf-8", "replace"), None)]
                except Exception as e:  # noqa: BLE001
                    found = [("", str(e))]
                rows += [(path, i + 1, text, error) for i, (text, error) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "page_num", "raw", "error"])

    return with_text(files.select("path", "content").mapInPandas(run, PAGES), keep_empty)


def with_text(x: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Raw pages (path, page_num, raw, error[, title, ...]) with file_type, text, heading, year and, where it is null, the
    title of the file's name; raw goes."""
    x = x.withColumn("file_type", file_type(F.col("path")))
    html = F.col("file_type").isin("epub", "html", "htm", "xhtml")
    x = x.withColumn("text", F.when(html, html_to_text(F.col("raw"))).otherwise(F.col("raw"))).withColumn("heading", F.when(html, html_heading(F.col("raw"))).otherwise(heading(F.col("text"))))
    named = title_from_path(F.col("path"))
    x = x.withColumn("title", F.coalesce("title", named) if "title" in x.columns else named).withColumn("year", year_guess(named, F.col("text")))
    if not keep_empty:
        x = x.filter(F.length(F.trim("text")) > 0)
    first = ["path", "title", "file_type", "page_num", "text", "heading", "year", "error"]
    return x.select(*first, *(c for c in x.columns if c not in {*first, "raw"}))


def page_counts(x: DataFrame, key: str = "path") -> DataFrame:
    """Pages of each document, and whether one of the first three holds over 100 letters."""
    return x.groupBy(key).agg(F.max("page_num").alias("n_pages"), F.max(F.coalesce((F.col("page_num") <= 3) & (F.length(F.trim("text")) > 100), F.lit(False))).alias("has_text"))


def thin_pages(x: DataFrame, least: int = 50) -> DataFrame:
    """Pages with too little text, which would need recognition from images."""
    return x.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) < least)


def ingest_report(x: DataFrame, key: str = "path", plan: DataFrame | None = None) -> DataFrame:
    """(status, n): ok and failed documents; one bad file doesn't stop the rest. plan: of index.scan_plan, whose skipped
    and deleted documents are counted too."""
    each = x.groupBy(key).agg(F.max(F.col("error").isNull()).alias("ok")).select(F.when(F.col("ok"), "ok").otherwise("failed").alias("status"))
    if plan is not None:
        each = each.union(plan.filter("action <> 'index'").select(F.when(F.col("action") == "skip", "skipped").otherwise("deleted")))
    return each.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def page(x: DataFrame, doc_id, number: int, key: str = "doc_id") -> DataFrame:
    """One page of a document, its number held between 1 and the last."""
    own = x.filter(F.col(key) == F.lit(doc_id))
    last = own.agg(F.max("page_num").alias("_last"))
    return own.crossJoin(F.broadcast(last)).filter(F.col("page_num") == F.greatest(F.lit(1), F.least(F.lit(number), F.col("_last")))).drop("_last")


def library(documents: DataFrame, by: str = "title") -> DataFrame:
    return documents.orderBy(F.lower(by), "doc_id")


def load_thesaurus(path: str | None, built_in: dict | None = None) -> Thesaurus:
    """A thesaurus file merged over built-in entries; a missing or broken file adds nothing."""
    base = Thesaurus(built_in or {})
    try:
        return base.merged(Thesaurus(json.loads(Path(path).read_text("utf-8")))) if path else base
    except (OSError, ValueError):
        return base


def save_thesaurus(t: Thesaurus, path: str) -> None:
    entries = {w: {"direct": t.direct[w], "concepts": t.concepts.get(w, [])} for w in sorted(t.direct)}
    Path(path).write_text(json.dumps(entries, ensure_ascii=False, indent=1), "utf-8")


def export_text(x: DataFrame, path: str, key: str = "doc_id") -> None:
    """Documents' pages in order, one text file part per partition of documents."""
    w = x.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "text"))), lambda r: r["text"]), "\n\n").alias("value"))
    w.select("value").write.mode("overwrite").text(path)


def export_json(results: DataFrame, path: str) -> None:
    results.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
