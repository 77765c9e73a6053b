"""SRC1-SRC7: TXT, EPUB and HTML to text. PDF needs a library that is not installed and says so.

Files are read as binary rows; each is decoded on its own, so nothing is shuffled and one bad file is one row's error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, suffix

#: Encodings in the order in which they are tried, and tags that break lines.
ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "cp1252", "latin-1")
BLOCK_TAGS = ("p", "div", "section", "article", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6")
_DECODED = "text string, encoding string"


def decode(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """SRC5: the first encoding that reads the bytes. Its order lets most even-length legacy text pass as UTF-16."""
    for name in encodings:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise UnicodeError("TEXT_DECODE_FAILED")


def decoded(content: Column, strict_order: bool = True) -> Column:
    """SRC5 as a struct of text and encoding; without strict_order UTF-16 needs its byte order mark.

    Valid UTF-8 never leaves the JVM; only other bytes go through Arrow.
    """
    names = ENCODINGS if strict_order else tuple(e for e in ENCODINGS if not e.startswith("utf-16-"))

    @F.pandas_udf(_DECODED)
    def others(values: pd.Series) -> pd.DataFrame:
        found = [(None, None) if v is None else decode(bytes(v), names) if strict_order or v[:2] in (b"\xff\xfe", b"\xfe\xff") else decode(bytes(v), tuple(n for n in names if n != "utf-16")) for v in values]
        return pd.DataFrame(found, columns=["text", "encoding"])

    plain = F.is_valid_utf8(content.cast("string"))
    return F.when(content.isNull(), F.lit(None)).when(plain, F.struct(content.cast("string").alias("text"), F.lit("utf-8").alias("encoding"))).otherwise(others(F.when(~plain, content)))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.parts.append("\n")


def text_of_html(markup: str) -> str:
    """SRC6: all character data, scripts included, with a line break at both ends of block tags."""
    reader = _Text()
    reader.feed(markup)
    reader.close()
    return "".join(reader.parts)


_AMPERSAND = re.compile("&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([a-zA-Z][a-zA-Z0-9]*;))?")


def text_of_closed_html(markup: str) -> str:
    """SRC6 where only references that end with their semicolon are read; &amp without one stays as it is written."""
    stand_in = next(chr(c) for c in range(0xF0000, 0xFFFFE) if chr(c) not in markup)
    held = _AMPERSAND.sub(lambda m: m[0] if m[1] or m[2] in html5 else stand_in + m[0][1:], markup)
    return text_of_html(held).replace(stand_in, "&")


def html_text(markup: Column, closed: bool = False) -> Column:
    """SRC6 over Arrow batches; closed: references without a semicolon are text."""
    read = text_of_closed_html if closed else text_of_html

    @F.pandas_udf("string")
    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else read(v))

    return each(markup)


def text_of_epub(content: bytes) -> str:
    """SRC4: the text of the spine's documents in order, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("}rootfile") or e.tag == "rootfile")
        root = ElementTree.fromstring(book.read(package))
        tag = lambda e: e.tag.rpartition("}")[2]
        items = {e.attrib["id"]: e.attrib for e in root.iter() if tag(e) == "item"}
        order = [items[e.attrib["idref"]] for e in root.iter() if tag(e) == "itemref" and e.attrib.get("idref") in items]
        here = posixpath.dirname(package)
        place = lambda href: posixpath.normpath(posixpath.join(here, unquote(href.partition("#")[0])))
        texts = [text_of_html(book.read(place(i["href"])).decode("utf-8", "ignore")) for i in order if i.get("media-type") == "application/xhtml+xml"]
    return "\n\n".join(texts)


def _epub(content: Column) -> Column:
    """SRC4 as a struct of text and error; any damage of a book is that book's error."""

    def one(v):
        if v is None:
            return None, None
        try:
            return text_of_epub(bytes(v)), None
        except Exception:  # noqa: BLE001
            return None, "EPUB_CONVERSION_FAILED"

    @F.pandas_udf("text string, error string")
    def each(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["text", "error"])

    return each(content)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """SRC1, SRC2: (path, source_filename, content, content_sha256) of the files at path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("source_filename"), "content", F.sha2("content", 256).alias("content_sha256"))


def convert(sources: DataFrame) -> DataFrame:
    """SRC1-SRC7: sources with text, encoding, source_type and error (null if the text is usable)."""
    kind = suffix(F.col("source_filename"))
    plain = decoded(F.when(kind == ".txt", F.col("content")))
    book = _epub(F.when(kind == ".epub", F.col("content")))
    rows = sources.withColumn("source_type", F.substring(kind, 2, 10)).withColumn("__plain", plain).withColumn("__book", book)
    text = F.coalesce("__plain.text", "__book.text")
    error = (
        F.when(~kind.isin(".txt", ".pdf", ".epub"), "UNSUPPORTED_FILE_TYPE").when(kind == ".pdf", "PDF_CONVERSION_UNAVAILABLE").when(F.col("__book.error").isNotNull(), F.col("__book.error"))
        .when(text.isNull() | is_blank(text), "SOURCE_EMPTY")
    )
    return rows.select(*sources.columns, "source_type", text.alias("text"), F.col("__plain.encoding").alias("encoding"), error.alias("error"))
