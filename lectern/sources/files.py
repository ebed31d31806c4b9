"""Readers of documents and catalogs: text, JSON, CSV, EPUB, listings of images; all lazy DataFrames.

Defined cases: a file that cannot be read gives no elements and no contents (one bad book does not end a
run); an unsupported extension is refused by ``supported``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.paths import base_name, extension, media_type
from lectern.functions.text import clean_page, clean_title, listed, parsed_size, strip
from lectern.functions.values import UPLOAD_BYTES
from lectern.operators.html import SCHEMA, Reader

SUPPORTED = ("txt", "epub", "kepub", "pdf")
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, content): each text file as one element."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.lit("text").alias("type"), F.col("value").alias("content"))


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The entries of JSON arrays, a row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def files(spark: SparkSession, path: str, ext: str = "*") -> DataFrame:
    """(path, name, ext, n_bytes, content) of files under a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}" if ext != "*" else "*").option("recursiveFileLookup", True).load(path)
    return found.select("path", base_name(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("n_bytes"), "content")


def supported(documents: DataFrame) -> DataFrame:
    """Files of a known kind that are not too large; others end the query with an error that names them."""
    fine = F.col("ext").isin(*SUPPORTED) & (F.col("n_bytes") <= UPLOAD_BYTES)
    return documents.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("not supported: "), F.col("path")))))


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """(catalog_id, title, author, subjects, bookshelves, language, issued_at) of a catalog's CSV (``.gz`` too).

    Rows count if their number is one, their type is Text and English is among their languages.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    rows = raw.where((F.col("Type") == "Text") & F.contains("Language", F.lit("en"))).withColumn("catalog_id", F.col("Text#").try_cast("int")).where("catalog_id IS NOT NULL")
    unless_empty = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    return rows.select("catalog_id", clean_title(F.col("Title")).alias("title"), unless_empty("Authors").alias("author"), unless_empty("Subjects").alias("subjects"), unless_empty("Bookshelves").alias("bookshelves"), unless_empty("Language").alias("language"), unless_empty("Issued").alias("issued_at"))


def subject_list(subjects: Column) -> Column:
    return listed(subjects, ";")


def pdf_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages of extracted text (doc_id, page, text) as text elements, cleaned; noise and short pages are left out."""
    rows = pages.withColumn("content", clean_page(F.col(text))).where("content <> ''")
    return rows.select("doc_id", F.col("page").alias("pos"), F.lit("text").alias("type"), "content", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("chapter"))


class Epub:
    """The parts of one EPUB: its pages in reading order, its contents, its images."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        self.package_path = next(x.attrib["full-path"] for x in container.iter() if x.tag.endswith("rootfile"))
        self.package = ElementTree.fromstring(self.zip.read(self.package_path))
        self.folder = posixpath.dirname(self.package_path)
        self.items = {x.attrib["id"]: x.attrib for x in self.package.iter() if x.tag.endswith("}item")}
        self.spine = [self.path(self.items[x.attrib["idref"]]["href"]) for x in self.package.iter() if x.tag.endswith("}itemref") and x.attrib.get("idref") in self.items]

    def path(self, link: str, base: str | None = None) -> str:
        return posixpath.normpath(posixpath.join(self.folder if base is None else posixpath.dirname(base), link))

    def elements(self) -> Iterator[dict]:
        reader = Reader()
        kinds = {self.path(x["href"]): x.get("media-type") for x in self.items.values()}
        for number, name in enumerate(self.spine, 1):
            for x in reader.read(self.zip.read(name).decode("utf-8", "replace")):
                x["spine_index"] = number
                if x["type"] == "image" and x.get("file"):
                    x["file"] = self.path(x["file"], name)
                    x["mime"] = kinds.get(x["file"])
                yield x

    def contents(self) -> Iterator[tuple[str, int, int, str | None]]:
        """(title, page, level, fragment) of each entry that leads to a page."""
        ncx = next((x for x in self.items.values() if x.get("media-type") == "application/x-dtbncx+xml"), None)
        if ncx is None:
            return
        name = self.path(ncx["href"])
        pages = {p: k for k, p in enumerate(self.spine, 1)}

        def walk(node: ElementTree.Element, level: int) -> Iterator[tuple[str, int, int, str | None]]:
            for point in (x for x in node if x.tag.endswith("navPoint")):
                title = " ".join("".join(t.text or "" for t in point.find("{*}navLabel").iter()).split())
                link, _, fragment = point.find("{*}content").attrib["src"].partition("#")
                if page := pages.get(self.path(link, name)):
                    yield title, page, level, fragment or None
                yield from walk(point, level + 1)

        for nav in (x for x in ElementTree.fromstring(self.zip.read(name)) if x.tag.endswith("navMap")):
            yield from walk(nav, 0)

    def images(self) -> Iterator[tuple[str, int]]:
        for x in self.zip.infolist():
            if re.search(r"\.(jpe?g|png|gif|svg|webp|bmp)\Z", x.filename, re.I):
                yield x.filename, x.file_size


_BROKEN = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, AttributeError, ValueError, EOFError)


def _from_epubs(books: DataFrame, each, schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = list(each(Epub(content.as_buffer().to_pybytes())))
                except _BROKEN:
                    rows = []
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["path", *names])

    return books.select("path", "content").mapInArrow(run, f"path string, {schema}")


def epub_elements(books: DataFrame) -> DataFrame:
    """path and the elements of each EPUB (``files``), in reading order; the chapter carries over from page to page."""
    types = [pa.int32() if f in ("pos", "spine_index") else pa.string() for f in _FIELDS]
    return _from_epubs(books, lambda book: [tuple((x | {"pos": i}).get(f) for f in _FIELDS) for i, x in enumerate(book.elements())], SCHEMA, types)


def epub_contents(books: DataFrame) -> DataFrame:
    """(path, idx, title, page, level, fragment) of each EPUB's table of contents."""
    return _from_epubs(books, lambda book: [(i, *x) for i, x in enumerate(book.contents())], "idx int, title string, page int, level int, fragment string", [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()])


def epub_images(books: DataFrame) -> DataFrame:
    """(path, name, n_bytes, mime) of each EPUB's images."""
    found = _from_epubs(books, lambda book: list(book.images()), "name string, n_bytes bigint", [pa.string(), pa.int64()])
    return found.withColumn("mime", media_type(F.col("name")))


def listed_images(lines: DataFrame, line: str = "value") -> DataFrame:
    """(page, nth, type, width, height, color, n_bytes) from the lines of a PDF image listing; other lines are left out."""
    words = F.split(F.trim(line), r"\s+")
    number = lambda k: F.get(words, F.lit(k)).try_cast("int")
    rows = lines.where(number(0).isNotNull() & (F.size(words) >= 15))
    return rows.select(number(0).alias("page"), number(1).alias("nth"), F.get(words, F.lit(2)).alias("type"), number(3).alias("width"), number(4).alias("height"), F.get(words, F.lit(5)).alias("color"), parsed_size(F.get(words, F.lit(14))).alias("n_bytes"))


def marked_images(content: Column) -> Column:
    """How often each kind of image begins in a binary: (jpeg, png, gif), by the bytes that it starts with."""
    marks = {"jpeg": (b"\xff\xd8\xff",), "png": (b"\x89PNG\r\n\x1a\n",), "gif": (b"GIF87a", b"GIF89a")}

    @F.arrow_udf("struct<jpeg:bigint,png:bigint,gif:bigint>")
    def count(binaries: pa.Array) -> pa.Array:
        found = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in binaries]
        return pa.StructArray.from_arrays([pa.array([sum(map(x.count, m)) for x in found], pa.int64()) for m in marks.values()], list(marks))

    return count(content)


def arriving(spark: SparkSession, path: str, ext: str = "txt") -> DataFrame:
    """A stream of the text files that lie in a folder or arrive there: (path, content)."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*.{ext}")
    return reader.load(path).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
