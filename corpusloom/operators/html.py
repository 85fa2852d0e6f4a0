"""Web pages to sections, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which tags are noise, sections, headings, content.
NOISE = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "button", "iframe", "svg", "canvas", "figure"}
SECTIONS, HEADINGS, CONTENT = {"article", "section", "main"}, {"h1", "h2"}, {"p", "li", "td", "th"}
META = {"author": "meta_author", "description": "meta_description", "keywords": "meta_keywords", "og:title": "meta_og_title", "og:description": "meta_og_description"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag that ends an open element of the same kind, as browsers do.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
ENDS_P = SECTIONS | HEADINGS | {"div", "ul", "ol", "table", "h3", "h4", "h5", "h6", "blockquote", "pre", "p"}
RESULT = "section_no int, title string, text string, html_title string, metadata map<string,string>"


class _Open:
    """An element whose text is being gathered."""

    def __init__(self, tag: str, attrs: dict[str, str], outer: bool) -> None:
        self.tag, self.attrs, self.outer = tag, attrs, outer
        self.parts: list[str] = []
        self.heading: str | None = None


class Sections(HTMLParser):
    """Collects sections, headings with their blocks, the body's text, title and metadata in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.noise = 0
        self.title, self.meta = "", {}
        self.roots: list[_Open] = []
        self.blocks: list[tuple[str, _Open]] = []
        self.body: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (named.get("name") or named.get("property") or "").lower()
            if name in META:
                self.meta[META[name]] = named.get("content", "")
        if tag in VOID:
            return
        for x in reversed(self.stack):
            if x.tag in CLOSES.get(tag, ()) or (x.tag == "p" and tag in ENDS_P):
                self.handle_endtag(x.tag)
                break
            if x.tag in ("table", "ul", "ol", *SECTIONS):
                break
        one = _Open(tag, named, any(x.tag in CONTENT for x in self.stack))
        self.stack.append(one)
        self.noise += tag in NOISE
        if not self.noise:
            if tag in SECTIONS:
                self.roots.append(one)
            if tag in HEADINGS or (tag in CONTENT and not one.outer):
                self.blocks.append((tag, one))

    def handle_endtag(self, tag: str) -> None:
        if any(x.tag == tag for x in self.stack):
            while self.stack:
                x = self.stack.pop()
                self.noise -= x.tag in NOISE
                if x.tag in HEADINGS:
                    for root in self.stack:
                        if root.tag in SECTIONS and root.heading is None:
                            root.heading = " ".join(x.parts)
                if x.tag == tag:
                    break

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text:
            return
        if any(x.tag == "title" for x in self.stack):
            self.title = self.title or text
            return
        if not self.noise and not any(x.tag == "head" for x in self.stack):
            self.body.append(text)
            for x in self.stack:
                x.parts.append(text)

    def sections(self) -> list[tuple[str, str]]:
        by_tag = [(self._title(r), "\n".join(r.parts)) for r in self.roots if r.parts]
        return by_tag or self._by_heading()

    @staticmethod
    def _title(root: _Open) -> str:
        if root.heading is not None:
            return root.heading
        return root.attrs.get("id") or (root.attrs.get("class", "").split() or [""])[0]

    def _by_heading(self) -> list[tuple[str, str]]:
        """Each block belongs to the last heading with text before it, number 0 being none; a heading at the very end has no section."""
        said = [(tag in HEADINGS, " ".join(block.parts)) for tag, block in self.blocks]
        said = [(heading, text) for heading, text in said if text]
        number = list(accumulate(heading for heading, _ in said))
        titles = ["", *(text for heading, text in said if heading)]
        parts: list[list[str]] = [[] for _ in titles]
        for k, (heading, text) in zip(number, said, strict=True):
            if not heading:
                parts[k].append(text)
        last = len(titles) - 1
        found = [(titles[k], "\n".join(p)) for k, p in enumerate(parts) if p or 0 < k < last]
        return found or [("", "\n".join(self.body))]


def parse(html: str) -> Sections:
    parser = Sections()
    parser.feed(html)
    parser.close()
    return parser


def extract_sections(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per section of each page. pages: html and the keys (page_id if none is named). A page that can't be parsed gives its bare text."""
    kept = pages.select(*(keys or [F.col("page_id").cast("long").alias("page_id")]), "html")
    named = kept.drop("html").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, html in enumerate(batch.column("html").to_pylist()):
                try:
                    p = parse(html or "")
                    rows += [(at, k, title, text, p.title, list(p.meta.items())) for k, (title, text) in enumerate(p.sections())]
                except AssertionError:  # the parser's own sign of broken markup
                    rows.append((at, 0, "", re.sub("<[^>]*>", " ", html).strip(), "", []))
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)]
            whose = [batch.column(f.name).take(columns[0]) for f in named]
            yield pa.RecordBatch.from_arrays([*whose, *columns[1:]], [*(f.name for f in named), "section_no", "title", "text", "html_title", "metadata"])

    return kept.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in named)}, {RESULT}")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def detect_charset(html: Column) -> Column:
    """What the first 4096 characters declare, else utf-8."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.substring(html, 1, 4096), "(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1)), F.lit("")), F.lit("utf-8"))
