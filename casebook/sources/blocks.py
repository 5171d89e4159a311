"""Text blocks from decoded documents: lines, markdown, HTML, sheets, tables, slides, captions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import SPACE, looks_numeric

BLOCKS = "doc_id bigint, ord bigint, text string, page int, section string"
CHARS_OUT = 1 << 20  # blocks leave a task whenever so many characters of pages have been read
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One block per non-blank stripped line (S4). No shuffle: a document is one row."""
    rows = documents.select(doc, *(carry or []), F.posexplode(F.split(text, LINE_BREAK)).alias("ord", "text"))
    return rows.withColumn("text", strip(F.col("text"))).filter("text <> ''")


def line_array(text: Column) -> Column:
    """The same lines as an array inside the row."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def markdown(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with the heading they stand under.

    The text is cut before each heading line, so the heading of a line is the head of its own piece:
    two generators instead of a window over the document.
    """
    pieces = documents.select(
        doc, F.posexplode(F.split(text, r"(?m)(?=^[ \t]*#)")).alias("piece", "part")
    ).withColumn("head", strip(F.element_at(F.split("part", LINE_BREAK), 1)))
    title = F.trim(F.regexp_replace("head", r"^[# ]+", ""))
    section = F.when(F.col("head").startswith("#"), title).otherwise("")
    rows = pieces.select(
        doc, "piece", section.alias("section"), F.posexplode(F.split("part", LINE_BREAK)).alias("line", "text")
    ).withColumn("text", strip(F.col("text")))
    order = (F.shiftleft(F.col("piece").cast("bigint"), 32) + F.col("line")).alias("ord")
    return rows.filter("text <> ''").select(doc, order, "text", "section")


# Elements that hold text, and elements dropped with everything inside.
_KEPT = frozenset({"h1", "h2", "h3", "p", "li", "td", "th"})
_DROPPED = frozenset({"script", "style", "nav", "footer"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


class _Blocks(HTMLParser):
    """Collects the text of each kept element; an open element sees all text until it is closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.hidden += tag in _DROPPED
        texts = None
        if tag in _KEPT and not self.hidden:
            texts = []
            self.found.append((tag, texts))
        self.open.append((tag, texts))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if any(name == tag for name, _ in self.open):
            while True:
                name, _ = self.open.pop()
                self.hidden -= name in _DROPPED
                if name == tag:
                    break

    def handle_data(self, data):
        text = data.strip()
        if text and not self.hidden:
            for _, texts in self.open:
                if texts is not None:
                    texts.append(text)


def html(pages: DataFrame, doc: str = "page_id", source: str = "html") -> DataFrame:
    """Blocks of headings, paragraphs, list items and cells in document order."""

    names = ["doc_id", "ord", "text", "page", "section"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def framed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            # one page at a time is text of its own; the others stay in the Arrow batch
            for key, markup in zip(batch.column(0), batch.column(1), strict=True):
                key, markup = key.as_py(), markup.as_py() or ""
                parser = _Blocks()
                parser.feed(markup)
                parser.close()
                blocks = [(tag, " ".join(texts)) for tag, texts in parser.found if texts]
                out += [(key, i, text, None, "Heading" if tag[0] == "h" else "") for i, (tag, text) in enumerate(blocks)]
                held += len(markup)
                if held > CHARS_OUT:
                    yield framed(out)
                    out, held = [], 0
            yield framed(out)

    return pages.select(F.col(doc).cast("bigint").alias(doc), source).mapInArrow(parse, BLOCKS)


def sheet_records(cells: DataFrame, header_rows: int | None = None) -> DataFrame:
    """Spreadsheet rows as record blocks.

    ``cells``: doc_id, sheet, row, col (from 1), value, is_text. The header stands above the records, and records have
    numbers: it is the best row above the first one with a numeric cell, by text labels, filled cells, then position. Where
    nothing stands above, it is the first row; where no cell is numeric, the first row of two cells or more. So no later
    row, however wordy, cuts off the records above it. With ``header_rows`` only the first so many rows are looked at.
    Grouping is by (document, sheet, row): a huge sheet is many small groups, combined in the map tasks.
    """
    sheet = ["doc_id", "sheet"]
    filled = cells.filter(F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    is_label = F.col("is_text") & ~looks_numeric(F.col("value"))
    tried = filled if header_rows is None else filled.filter(F.col("row") <= header_rows)
    scored = (
        tried.groupBy(*sheet, "row")
        .agg(F.count_if(is_label).alias("labels"), F.count(F.lit(1)).alias("cells"))
    )
    edges = scored.groupBy(*sheet).agg(
        F.min(F.when(F.col("labels") < F.col("cells"), F.col("row"))).alias("first_number"),
        F.min(F.when(F.col("cells") > 1, F.col("row"))).alias("first_wide"),
        F.min("row").alias("first_row"),
    )
    above = scored.filter("labels = cells").join(edges, sheet).filter("row < first_number")
    best = above.groupBy(*sheet).agg(F.max_by("row", F.struct("labels", "cells", (-F.col("row")).alias("early"))).alias("best"))
    order = F.when(F.col("first_number").isNull(), F.col("first_wide")).otherwise(F.col("best"))
    heads = edges.join(best, sheet, "left").select(*sheet, F.coalesce(order, "first_row").alias("head_row"))
    head_cells = (
        tried.join(heads, sheet)
        .filter("row = head_row")
        .select(*sheet, "col", strip(F.col("value")).alias("name"))
    )
    named = (
        filled.join(heads, sheet)
        .filter("row > head_row")
        .join(head_cells, [*sheet, "col"], "left")
        .withColumn("name", F.coalesce("name", F.concat(F.lit("Column "), F.col("col").cast("string"))))
    )
    cell = F.struct("col", F.concat_ws(": ", "name", "value").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["t"]), " | ")
    return named.groupBy(*sheet, "row").agg(joined.alias("record")).select(
        "doc_id",
        F.col("row").cast("bigint").alias("ord"),
        F.format_string("Sheet %s — Row %d — %s", "sheet", "row", "record").alias("text"),
        F.lit(None).cast("int").alias("page"),
        F.col("sheet").alias("section"),
    )


def table_row(cells: Column) -> Column:
    """A table row as one line, null when every cell is blank."""
    tidy = F.transform(cells, lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))
    return F.when(F.exists(tidy, lambda c: c != ""), F.array_join(tidy, " | "))


def slides(slide_lines: DataFrame) -> DataFrame:
    """One block per slide: its lines in order, repeats dropped, title as section.

    ``slide_lines``: doc_id, page, ord, text, title.
    """
    kept = slide_lines.filter(strip(F.col("text")) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("t")))), lambda x: x["t"])
    return kept.groupBy("doc_id", "page").agg(
        F.array_join(F.array_distinct(ordered), "\n").alias("text"), F.first("title").alias("section")
    )


CAPTION_START = r"(?i)^\s*(fig(ure)?\.?\s*[0-9]+|diagram|schematic|block diagram)"
FIGURE_SIDE = 150
FIGURE_BYTES = 5000
FIGURE_BLOCK = 1 << 20


def caption(page_text: Column, page: Column, width: int | None = None) -> Column:
    """The line that captions a page's figures (C10), whole unless a ``width`` is given."""
    found = line_array(page_text)
    titled = F.filter(found, lambda x: x.rlike(CAPTION_START))
    mentions = F.filter(found, lambda x: F.lower(x).contains("figure") | F.lower(x).contains("diagram"))
    line = F.coalesce(F.try_element_at(titled, F.lit(1)), F.try_element_at(mentions, F.lit(1)))
    line = line if width is None else F.left(line, F.lit(width))
    return F.coalesce(line, F.concat(F.lit("Image from page "), page.cast("string")))


def embedded_caption(number: Column, filename: Column) -> Column:
    """Caption and locator of a figure inside a text document, which has no page to take a line from (C11)."""
    return F.struct(
        F.concat(F.lit("Figure "), number.cast("string"), F.lit(" from "), filename).alias("caption"),
        F.concat(F.lit("embedded image "), number.cast("string")).alias("locator"),
    )


def admit_figures(images: DataFrame, limit: int | None = None) -> DataFrame:
    """Images large enough to be figures, numbered within their document (C11); ``limit`` keeps the first of each.

    ``images``: doc_id, kind ('pdf' or 'docx'), ord, width, height, bytes.
    """
    from casebook.operators.windows import numbered, top_k

    big = F.when(
        F.col("kind") == "pdf", (F.col("width") >= FIGURE_SIDE) & (F.col("height") >= FIGURE_SIDE)
    ).otherwise(F.col("bytes") >= FIGURE_BYTES)
    if limit is None:
        return numbered(images.filter(big), ["doc_id"], "ord", FIGURE_BLOCK, "figure_no").drop("_block")
    return top_k(images.filter(big), ["doc_id"], [F.col("ord")], limit, "figure_no")
