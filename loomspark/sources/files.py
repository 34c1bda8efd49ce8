"""Files as blocks: plain text, CSV and XLSX sheets, HTML pages. Other formats go to a parser that the caller registers."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import route_format

from .html import page_blocks

BLOCK = "path string, ord int, text string, kind string, page int, row int, engine string, error string"
Parsed = list[tuple[str, str | None, int, int | None]]
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_text(data: bytes) -> Parsed:
    return [(t, None, 1, None) for p in re.split(r"\n{2,}", data.decode("utf-8", "replace").replace("\r\n", "\n")) if (t := p.strip())]


def _sheet_rows(rows: list[list[str]], sheet: int) -> Parsed:
    return [(" | ".join(c.replace("|", "\\|") for c in row), "table", sheet, i) for i, row in enumerate(rows, 1) if any(c.strip() for c in row)]


def parse_csv(data: bytes) -> Parsed:
    return _sheet_rows(list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace")))), 1)


def parse_xlsx(data: bytes) -> Parsed:
    """Cell texts of every sheet: shared and inline strings, and values as they are written."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        out: Parsed = []
        for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
            rows: list[list[str]] = []
            for row in ET.fromstring(z.read(n)).iter(f"{_NS}row"):
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:  # type: ignore[index]
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    v = c.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if v is None else v.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" else text)
                rows += [[]] * (int(row.get("r", len(rows) + 1)) - 1 - len(rows)) + [cells]
            out += _sheet_rows(rows, int(re.findall(r"\d+", n)[0]))
        return out


def parse_html(data: bytes) -> Parsed:
    return [(text, kind, 1, None) for text, kind, _, _ in page_blocks(data.decode("utf-8", "replace"))]


def read_blocks(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], Parsed]] | None = None) -> DataFrame:
    """Blocks of every file below path. parsers: of formats ('pdf', 'image', 'office', 'soffice', 'legacy_sheet') whose
    engines aren't part of the library. A file that can't be parsed gives one row with its error."""
    own = {"text": parse_text, "sheet": None} | (parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for p, data, form in zip(b["path"], b["content"], b["format"]):
                page = form == "office" and p.lower().endswith((".html", ".htm")) and "office" not in own
                parse = parse_html if page else (parse_csv if p.lower().endswith(".csv") else parse_xlsx) if form == "sheet" and own["sheet"] is None else own.get(form)
                engine = "sheet" if form == "sheet" else form
                try:
                    if parse is None:
                        raise LookupError(f"no parser for {form}")
                    rows += [(p, k, t, kind, page, row, engine, None) for k, (t, kind, page, row) in enumerate(parse(bytes(data)))]
                except Exception as wrong:  # noqa: BLE001 - a bad file must not end the job
                    rows.append((p, None, None, None, None, None, engine, str(wrong)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK.split(", ")]).astype({"ord": "Int32", "page": "Int32", "row": "Int32"})

    return files.select("path", "content", route_format(F.col("path")).alias("format")).mapInPandas(run, BLOCK)
