"""HTML pages as blocks: elements with a data-bbox on a grid of a thousand, tables row by row, or the whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.shared import spread

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header footer nav ul ol table main aside".split())


class _Page(HTMLParser):
    """Collects (label, box, text, table rows) of the boxed elements, and the text of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.text: list[str] = []
        self.quiet = 0
        self.row: list[tuple[str, bool, int, int]] | None = None
        self.cell: list[str] | None = None
        self.span = (1, 1, False)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag in ("script", "style", "template"):
            self.quiet += 1
        if "data-bbox" in given:
            numbers = [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?", given["data-bbox"] or "")]
            item = {"tag": tag, "label": given.get("data-label") or "text", "box": numbers if len(numbers) == 4 else None, "text": [], "rows": [], "depth": 0}
            self.done.append(item)
            if tag not in _VOID:
                self.open.append(item)
        elif self.open and tag == self.open[-1]["tag"]:
            self.open[-1]["depth"] += 1
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            size = lambda k: max(1, int(m[0])) if (m := re.match(r"\d+", given.get(k) or "")) else 1
            self.cell, self.span = [], (size("rowspan"), size("colspan"), tag == "th")
        if tag in _BREAKS:
            self._put("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.quiet = max(0, self.quiet - 1)
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append((" ".join("".join(self.cell).split()), self.span[2], self.span[0], self.span[1]))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            for item in self.open[-1:]:
                item["rows"].append(self.row)
            self.row = None
        if tag in _BREAKS:
            self._put("\n")
        if self.open and tag == self.open[-1]["tag"]:
            if self.open[-1]["depth"]:
                self.open[-1]["depth"] -= 1
            else:
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self._put(data)

    def _put(self, data: str) -> None:
        if self.cell is not None and data != "\n":
            self.cell.append(data)
        for item in self.open[-1:]:
            item["text"].append(data)
        self.text.append(data)


def table_grid(rows: list[list[tuple[str, bool, int, int]]]) -> list[list[tuple[str, bool] | None]]:
    """Rows of (text, is header, rowspan, colspan) as a grid: a spanned place repeats the text of a header, else ''."""
    grid: dict[tuple[int, int], tuple[str, bool]] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, header, down, across in row:
            while (r, c) in grid:
                c += 1
            for dr in range(min(down, len(rows) - r)):
                for dc in range(across):
                    grid[r + dr, c + dc] = (text if (dr, dc) == (0, 0) or header else "", header)
            c += across
    width = 1 + max((c for _, c in grid), default=-1)
    return [[grid.get((r, c)) for c in range(width)] for r in range(len(rows))]


def grid_lines(grid: list[list[tuple[str, bool] | None]]) -> list[str]:
    """A line for each row below the header, as operators.layout.describe_grid has it."""
    end = next((i for i, row in enumerate(grid) if not any(c and c[1] for c in row)), None) or min(1, max(0, len(grid) - 1))
    width = max(map(len, grid), default=0)
    heads: list[str] = []
    for c in range(width):
        parts: list[str] = []
        for row in grid[:end]:
            text = next((cell[0] for cell in reversed(row[: c + 1]) if cell and cell[0]), "")
            if text and parts[-1:] != [text]:
                parts.append(text)
        heads.append(" · ".join(parts))
    lines = [" │ ".join(cell[0] if c == 0 or not heads[c] else f"{heads[c]}: {cell[0]}" for c, cell in enumerate(row) if cell and cell[0]) for row in grid[end:]]
    return [line for line in lines if line]


def page_blocks(html: str | None, width: float = 612.0, height: float = 792.0) -> list[tuple[str, str, tuple[float, float, float, float] | None, bool]]:
    """(text, kind, box with y upward, self-labelled) of a page; one block without a box where no element has one."""
    if not html:
        return []
    page = _Page()
    page.feed(html)
    page.close()
    tidy = lambda s: " ".join(s.split())
    out = []
    for item in page.done:
        b = item["box"]
        box = (b[0] * width / 1000, height - b[1] * height / 1000, b[2] * width / 1000, height - b[3] * height / 1000) if b else None
        if item["rows"]:
            out += [(line, "table", box, True) for line in grid_lines(table_grid(item["rows"]))]
        else:
            out += [(t, item["label"], box, False) for part in re.split(r"\n|\s{3,}", "".join(item["text"])) if (t := tidy(part))]
    if not page.done:
        whole = "\n".join(t for line in "".join(page.text).split("\n") if (t := tidy(line)))
        return [(whole, "text", None, False)] if whole else []
    kept: list = []
    start = 0
    while start < len(out):  # three or more equal blocks in a row are one
        end = start
        while end < len(out) and out[end] == out[start]:
            end += 1
        kept += out[start:end] if end - start < 3 else out[start : start + 1]
        start = end
    return kept


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, kind, self_labeled, text, bbox) of pages (page_id, html): a map over rows."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, kind, own, text, dict(zip("ltrb", box)) if box else None) for i, h in zip(b["page_id"], b["html"]) for k, (text, kind, box, own) in enumerate(page_blocks(h))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "kind", "self_labeled", "text", "bbox"])

    return spread(pages.select("page_id", F.col("html"))).mapInPandas(run, f"page_id {kind}, ord int, kind string, self_labeled boolean, text string, bbox struct<l:double,t:double,r:double,b:double>")
