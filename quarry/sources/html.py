"""HTML pages to text, in Arrow batches, with the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is not the page's own; those that start a line; those that have no end tag.
FURNITURE = frozenset({"script", "style", "nav", "header", "footer", "aside", "noscript"})
FORMS = frozenset({"form"})
_BLOCK = {"p", "div", "li", "tr", "section", "article", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Pages read at once: only so many are Python strings beside the batch.
PAGES = 64


class _Page(HTMLParser):
    """Keeps the path of open elements: an end tag closes what was left open inside its element, and nothing else."""

    def __init__(self, hide: frozenset[str], marks: bool):
        super().__init__(convert_charrefs=True)
        self.hide, self.marks, self.path, self.pieces = hide, marks, [], []

    def shown(self) -> bool:
        return self.hide.isdisjoint(self.path)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.path.append(tag)
        if tag in _BLOCK and self.shown():
            mark = "#" * int(tag[1]) + " " if tag in _HEADINGS else "- " if tag == "li" else ""
            self.pieces.append("\n" + mark * self.marks)

    def handle_endtag(self, tag):
        if tag not in self.path:
            return
        if self.shown():
            self.pieces.append(" | " if tag in ("td", "th") else "\n" * (tag in _BLOCK))
        del self.path[len(self.path) - 1 - self.path[::-1].index(tag) :]

    def handle_data(self, data):
        if self.shown():
            self.pieces.append(data)


def to_text(html: str | None, hide: frozenset[str] = FURNITURE | FORMS, marks: bool = True) -> str:
    """Cells split by |, and with ``marks`` headings as # and list items as -; what is in ``hide`` is left out."""
    if not html:
        return ""
    page = _Page(hide, marks)
    page.feed(html)
    page.close()
    lines = (" ".join(x.split()).removesuffix(" |").strip() for x in "".join(page.pieces).split("\n"))
    return "\n".join(x for x in lines if x)


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html", hide: frozenset[str] = FURNITURE | FORMS, marks: bool = True) -> DataFrame:
    """(key, text)"""
    rows = pages.select(F.col(key), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, PAGES):
                part = b.slice(k, PAGES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_text(x.as_py(), hide, marks) for x in part.column(1)], pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, heading, body): the text between headings; what comes before the first has none."""
    text = page_text(pages, key, html)
    parts = text.select(key, F.posexplode(F.split(F.concat(F.lit("\n"), "text"), "\n(?=#)")).alias("ord", "part"))
    heading = F.regexp_extract("part", "^#+ *([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("part", "^#[^\n]*\n?", ""), "^\\s+|\\s+$", "")
    return parts.select(key, "ord", heading.alias("heading"), body.alias("body")).where((F.col("heading") != "") | (F.col("body") != ""))


#: The most columns that one cell spans.
SPAN = 8
_CELL = pa.struct([("th", pa.bool_()), ("span", pa.int32()), ("text", pa.string())])


class _Tables(HTMLParser):
    """The rows of every table: each cell with its kind, its span and its text, links as [text](address)."""

    def __init__(self, hide: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.hide, self.hidden, self.found, self.open = hide, [], [], []

    def _end_cell(self, table: dict) -> None:
        if table["cell"] is not None:
            cell, table["cell"] = table["cell"], None
            table["rows"][-1].append({"th": cell["th"], "span": cell["span"], "text": " ".join("".join(cell["text"]).split()).replace("|", "/")})

    def handle_starttag(self, tag, attrs):
        if tag in self.hide:
            self.hidden.append(tag)
        if self.hidden:
            return
        now = self.open[-1] if self.open else None
        if tag == "table":
            self.open.append({"caption": [], "rows": [], "cell": None, "in_caption": False})
            self.found.append(self.open[-1])
        elif now and tag == "caption":
            now["in_caption"] = True
        elif now and tag == "tr":
            self._end_cell(now)
            now["rows"].append([])
        elif now and tag in ("td", "th"):
            self._end_cell(now)
            if not now["rows"]:
                now["rows"].append([])
            span = dict(attrs).get("colspan") or "1"
            now["cell"] = {"th": tag == "th", "span": max(1, min(int(span), SPAN)) if span.isascii() and span.isdigit() else 1, "text": [], "link": None}
        elif now and now["cell"] is not None:
            if tag == "a" and dict(attrs).get("href"):
                now["cell"]["link"] = dict(attrs)["href"]
                now["cell"]["text"].append("[")
            elif tag in _BLOCK:
                now["cell"]["text"].append(" ")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        now = self.open[-1] if self.open else None
        if not now:
            return
        if tag == "table":
            self._end_cell(now)
            self.open.pop()
        elif tag == "caption":
            now["in_caption"] = False
        elif tag in ("td", "th", "tr"):
            self._end_cell(now)
        elif tag == "a" and now["cell"] is not None and now["cell"]["link"]:
            now["cell"]["text"].append(f"]({now['cell']['link']})")
            now["cell"]["link"] = None

    def handle_data(self, data):
        if not self.hidden and self.open:
            now = self.open[-1]
            if now["in_caption"]:
                now["caption"].append(data)
            elif now["cell"] is not None:
                now["cell"]["text"].append(data)


def tables(pages: DataFrame, key: str = "page_id", html: str = "html", hide: frozenset[str] = FURNITURE | FORMS) -> DataFrame:
    """(key, ord, text): every table of a page as Markdown, nested ones by themselves.

    Only the cells are read in Python. A cell that spans columns is followed by
    empty ones, rows without text go, short rows are filled up. The rows of th
    cells that a table begins with are its head; without one its rows are their
    cells joined by bars, and no head is made up.
    """
    rows = pages.select(F.col(key), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, captions, found = [], [], [], []
            for k, page in enumerate(batch.column(1)):
                parser = _Tables(hide)
                parser.feed(page.as_py() or "")
                parser.close()
                for table in parser.open:
                    parser._end_cell(table)
                for n, table in enumerate(parser.found):
                    keys.append(k)
                    places.append(n)
                    captions.append(" ".join("".join(table["caption"]).split()))
                    found.append(table["rows"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(places, pa.int32()), pa.array(captions, pa.string()), pa.array(found, pa.list_(pa.list_(_CELL)))], names=["key", "ord", "caption", "rows"])

    parsed = rows.mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, ord int, caption string, rows array<array<struct<th:boolean,span:int,text:string>>>")
    blank = lambda n: F.array_repeat(F.lit(""), n)
    grid = F.transform("rows", lambda r: F.struct(F.exists(r, lambda c: c["th"]).alias("th"), F.flatten(F.transform(r, lambda c: F.concat(F.array(c["text"]), blank(c["span"] - 1)))).alias("cells")))
    grid = parsed.withColumn("grid", F.filter(grid, lambda r: F.exists(r["cells"], lambda c: c != ""))).where(F.size("grid") > 0)
    width = grid.withColumn("width", F.array_max(F.transform("grid", lambda r: F.size(r["cells"]))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r["cells"], blank(F.col("width") - F.size(r["cells"]))), " | "), F.lit(" |"))
    headed = F.concat(F.array(line(F.get("grid", F.lit(0)))), F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("width")))), F.transform(F.slice("grid", 2, F.size("grid")), line))
    plain = F.transform("grid", lambda r: F.array_join(F.filter(r["cells"], lambda c: c != ""), " | "))
    body = F.array_join(F.when(F.get("grid", F.lit(0))["th"], headed).otherwise(plain), "\n")
    return width.select(F.col("key").alias(key), "ord", F.concat(F.when(F.col("caption") != "", F.concat("caption", F.lit("\n"))).otherwise(""), body).alias("text"))
