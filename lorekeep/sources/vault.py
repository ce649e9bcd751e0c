"""Readers of the knowledge base: markdown trees, front matter, transcripts, logs, reading documents, books."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import grammar_key


def markdown_tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(rel, kind, text) of every ``.md`` file below ``root``; ``kind`` is the first folder, ``_`` folders are generated pages."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.md")
    rel = F.regexp_extract("path", r"^(?:[a-z]+:)?/*" + re.escape(root.split(":", 1)[-1].strip("/")) + r"/(.*)$", 1)
    named = files.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))
    out = named.select(rel.alias("rel"), "text")
    return out.select("rel", F.when(F.instr("rel", "/") > 0, F.substring_index("rel", "/", 1)).otherwise("").alias("kind"), "text")


def front_matter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``meta`` (map of scalars), ``lists`` (map of inline and block lists) and ``body``.

    Scalars lose their quotes; ``null`` and ``~`` are null; a page without front
    matter has empty maps and all of its text as body.
    """
    head = F.regexp_extract(text_col, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    body = F.regexp_replace(text_col, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    # Block lists become inline ones first: a key line and the dashed lines under it.
    flat = F.regexp_replace(head, r"\n[ \t]*-[ \t]+", "\x02")
    lines = F.filter(F.split(flat, "\n"), lambda x: x.rlike(r"^[\w-]+:"))
    key = lambda x: F.regexp_extract(x, r"^([\w-]+):", 1)
    raw = lambda x: F.trim(F.regexp_replace(x, r"^[\w-]+:", ""))
    bare = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    is_list = lambda x: raw(x).rlike(r"^\[.*\]$") | x.contains("\x02")
    parts = lambda x: F.filter(F.transform(F.split(F.regexp_replace(raw(x), r"^\[|\]$", ""), "[,\x02]"), bare), lambda y: y != "")
    scalars = F.transform(F.filter(lines, lambda x: ~is_list(x)), lambda x: F.struct(key(x), F.when(~raw(x).isin("null", "~", ""), bare(raw(x)))))
    lists = F.transform(F.filter(lines, is_list), lambda x: F.struct(key(x), parts(x)))
    last = lambda pairs: F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["col1"] == p["col1"])))
    return df.withColumn("meta", last(scalars)).withColumn("lists", last(lists)).withColumn("body", body)


TRANSCRIPT = "segments array<struct<text string, start double, end double, speaker string, words array<struct<word string, start double, end double, score double>>>>, language string"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, start, end, speaker, text) of transcript JSON files; malformed files give no rows."""
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.posexplode("segments").alias("ord", "s"))
    return rows.select("file", "ord", "s.start", "s.end", "s.speaker", F.trim("s.text").alias("text"))


def ingest_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Parsed log lines, as a batch or a stream."""
    from ..streaming.reviews import parse_log

    return parse_log((spark.readStream if stream else spark.read).text(path))


_HEADS, _PARAS, _SKIP = {"h1", "h2", "h3", "h4"}, {"p", "li", "blockquote", "dd"}, {"script", "style", "noscript", "nav"}


class _BlockParser(HTMLParser):
    """Collects (kind, text) of headings and paragraphs; images and skipped elements add nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self._kind, self._text, self._skipped = "", [], 0

    def _close(self) -> None:
        text = " ".join("".join(self._text).split())
        if self._kind and text:
            self.blocks.append((self._kind, text))
        self._kind, self._text = "", []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self._skipped += 1
        elif tag in _HEADS or tag in _PARAS:
            self._close()
            self._kind = "heading" if tag in _HEADS else "paragraph"

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self._skipped = max(0, self._skipped - 1)
        elif tag in _HEADS or tag in _PARAS:
            self._close()

    def handle_data(self, data):
        if self._kind and not self._skipped:
            self._text.append(data)


def html_blocks(source: str) -> list[tuple[str, str]]:
    parser = _BlockParser()
    parser.feed(source)
    parser.close()
    parser._close()
    return parser.blocks


_NAMES = re.compile(r"^(cover|toc|nav|copyright|title|titlepage)(?:$|[-._ ])", re.IGNORECASE)


def _epub(data: bytes) -> Iterator[tuple[int, str, str, str]]:
    """(spine place, item, kind, text) of a book's reading order, without cover, contents and the like."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if tag(e) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if tag(e) == "item"}
        spine = [items[e.attrib["idref"]] for e in package.iter() if tag(e) == "itemref" and e.attrib["idref"] in items]
        for place, href in enumerate(spine):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))
            if name.startswith("..") or name not in z.namelist() or _NAMES.match(posixpath.splitext(posixpath.basename(name))[0]):
                continue
            for kind, text in html_blocks(z.read(name).decode("utf-8", "replace")):
                yield place, name, kind, text


def epub_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, spine, item, ord, kind, text, error) of ``.epub`` files; a broken book is one row with its error."""
    fields = pa.schema([("file", pa.string()), ("spine", pa.int32()), ("item", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(file, s, n, i, k, t, None) for i, (s, n, k, t) in enumerate(_epub(data))]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    rows = [(file, None, None, None, None, None, type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(path)
    return books.select("path", "content").mapInArrow(run, "file string, spine int, item string, ord int, kind string, text string, error string")


#: Parts of a book of more bytes are not read for its title.
_PART_BYTES = 2 << 20

#: Titles that say nothing.
_NO_TITLES = ("untitled", "unknown", "unknown title")


def _book_names(data: bytes) -> tuple[str, str]:
    """(title, creators); both empty where the package is broken or too large."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:

            def part(name: str) -> ElementTree.Element:
                if z.getinfo(name).file_size > _PART_BYTES:
                    raise KeyError(name)
                return ElementTree.fromstring(z.read(name))

            found = [e.attrib["full-path"] for e in part("META-INF/container.xml").iter() if local(e) == "rootfile"]
            package = part(found[0])
    except (KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, OSError):
        return "", ""
    names: dict[str, list[str]] = {"title": [], "creator": []}
    for e in package.iter():
        text = " ".join((e.text or "").split())
        if text and local(e) in names:
            names[local(e)].append(text)
    title = next(iter(names["title"]), "")
    return "" if title.casefold() in _NO_TITLES else title, ", ".join(names["creator"])


def epub_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, creators) of ``.epub`` files; what a book does not tell is empty.  Files of no bytes have no row."""
    fields = pa.schema([("file", pa.string()), ("title", pa.string()), ("creators", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, (file, *_book_names(data.as_py()))))], schema=fields)

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(path)
    return books.select("path", "content").mapInArrow(run, "file string, title string, creators string")


def grammar_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, lemma) of a card bank, ``{"cards": [{"lemma": ...}]}``: the parts of a lemma between ``／``, with and without ``（...）``.

    Of cards with one alias the first one has it.
    """
    bank = spark.read.schema("cards array<struct<lemma:string>>").json(path, multiLine=True)
    cards = bank.select(F.posexplode("cards").alias("card", "c")).select("card", F.col("c.lemma").alias("lemma"))
    parts = cards.select("card", "lemma", F.explode(F.split("lemma", "／")).alias("part"))
    both = F.array("part", F.regexp_replace("part", "（[^）]*）", ""))
    keys = parts.select("card", "lemma", F.explode(both).alias("alias")).withColumn("alias", grammar_key(F.col("alias"))).filter("alias <> ''")
    return keys.groupBy("alias").agg(F.min_by("lemma", "card").alias("lemma"))
