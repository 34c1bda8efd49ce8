"""Pages and documents through services: rendering, reading by a vision model, layout engines and conversion are callables
that the caller supplies; here is what is done around them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import layout
from loomspark.operators.pages import resilient

from .html import page_blocks

T = TypeVar("T")
BLOCK = f"doc_id {{kind}}, page int, ord int, text string, kind string, self_labeled boolean, bbox {layout.BOX}, engine string, error string"
#: Longest side, in pixels, of what a vision model is shown, and pixels for a point otherwise.
LONGEST, SCALE = 1600, 2.0
TILES = 2


def render_scale(width: float, height: float) -> float:
    return min(SCALE, LONGEST / max(width, height, 1e-9))


def poll(submit: Callable[[], T], state: Callable[[T], tuple[bool, object]], wait: float = 5.0, deadline: float = 600.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> object:
    """Submit a job and ask for its state until it is done; TimeoutError after the deadline."""
    job, began = resilient(submit), clock()
    while True:
        done, result = resilient(lambda: state(job))
        if done:
            return result
        if clock() - began > deadline:
            raise TimeoutError(f"no result after {deadline:g} s")
        sleep(wait)


def _box(box: tuple[float, float, float, float] | None) -> dict | None:
    return None if box is None else dict(zip("ltrb", map(float, box)))


def read_pages(pages: DataFrame, read: Callable[[bytes], str], tiles: Callable[[bytes, float, float], bytes] | None = None, pause: float = 0.7, engine: str = "vlm") -> DataFrame:
    """Blocks of pages (doc_id, page, image, width, height in points), each image read as HTML by a vision model.

    A task reads its pages one by one with pauses. A page that fails gives one row with its error and no text. One that
    comes back as a single block without a box is read again in tiles, tiles(image, y0, y1) cutting a band, and keeps the
    boxed blocks of those, if there are any; a tile that fails is empty. A document none of whose pages has text is an
    error when its rows are read."""
    kind = dict(pages.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for b in batches:
            rows: list[tuple] = []
            for doc, page, image, width, height in zip(b["doc_id"], b["page"], b["image"], b["width"], b["height"]):
                if not first:
                    time.sleep(pause)
                first = False
                try:
                    found = page_blocks(resilient(lambda: read(bytes(image))), width, height)
                except Exception as wrong:  # noqa: BLE001 - one page must not end the document
                    rows.append((doc, page, 0, None, None, False, None, engine, str(wrong)))
                    continue
                if len(found) == 1 and found[0][2] is None and tiles is not None:
                    found = _tiled(bytes(image), read, tiles, width, height, pause) or found
                rows += [(doc, page, k, text, kind_, own, _box(box), engine, None) for k, (text, kind_, box, own) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord", "text", "kind", "self_labeled", "bbox", "engine", "error"])

    blocks = pages.select("doc_id", "page", "image", "width", "height").mapInPandas(run, BLOCK.format(kind=kind))
    some = F.max(F.coalesce(F.trim("text") != "", F.lit(False))).over(Window.partitionBy("doc_id"))
    empty = F.raise_error(F.concat(F.lit("no page of this document has text: "), F.col("doc_id").cast("string")))
    return blocks.withColumn("ord", F.when(some, F.col("ord")).otherwise(empty.cast("int")))


def _tiled(image: bytes, read: Callable[[bytes], str], tiles: Callable[[bytes, float, float], bytes], width: float, height: float, pause: float) -> list:
    out = []
    for k in range(TILES):
        low, high = height * k / TILES, height * (k + 1) / TILES
        if k:
            time.sleep(pause)
        try:
            found = page_blocks(read(tiles(image, low, high)), width, high - low)
        except Exception:  # noqa: BLE001 - a band that can't be read is left out
            continue
        out += [(text, kind, (b[0], b[1] + low, b[2], b[3] + low), own) for text, kind, b, own in found if b]
    return out


def layout_blocks(pages: DataFrame, read: Callable[[bytes], list[dict]], engine: str = "layout") -> DataFrame:
    """Blocks of pages (doc_id, page, image, height) by an engine that tells text, kind and a box with y downward."""
    kind = dict(pages.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, k, r["text"], r.get("kind") or "text", False, _box(r.get("bbox")), engine, None) for d, p, image in zip(b["doc_id"], b["page"], b["image"]) for k, r in enumerate(resilient(lambda: read(bytes(image))))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord", "text", "kind", "self_labeled", "bbox", "engine", "error"])

    found = pages.select("doc_id", "page", "image").mapInPandas(run, BLOCK.format(kind=kind))
    tall = pages.select("doc_id", "page", "height")
    return found.join(tall, ["doc_id", "page"]).withColumn("bbox", layout.to_bottom_left(F.col("bbox"), F.col("height"))).drop("height")


def read_regions(regions: DataFrame, crop: Callable[[bytes, int, tuple], bytes], read: Callable[[bytes], str]) -> DataFrame:
    """regions (id, content, page, bbox) with text: what a model reads in that part of the page."""

    @F.pandas_udf("string")
    def texts(content: pd.Series, page: pd.Series, box: pd.DataFrame) -> pd.Series:
        boxes = box[["l", "t", "r", "b"]].itertuples(index=False, name=None)
        return pd.Series(["\n".join(t for t, *_ in page_blocks(resilient(lambda: read(crop(bytes(c), int(p), b))))) for c, p, b in zip(content, page, boxes)], dtype="object")

    return regions.withColumn("text", texts("content", "page", "bbox"))


def converted(files: DataFrame, convert: Callable[[bytes, str], bytes]) -> DataFrame:
    """files (path, content) as PDF, where convert makes that of office formats; error says why one could not be."""

    @F.pandas_udf("content binary, error string")
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for p, c in zip(path, content):
            try:
                out.append((bytes(c) if p.lower().endswith(".pdf") else resilient(lambda: convert(bytes(c), p)), None))
            except Exception as wrong:  # noqa: BLE001 - a bad file must not end the job
                out.append((None, str(wrong)))
        return pd.DataFrame(out, columns=["content", "error"])

    return files.select("path", run("path", "content").alias("x")).select("path", "x.*")


def text_layers(files: DataFrame, lines: Callable[[bytes], list[tuple[int, str, tuple[float, float, float, float]]]]) -> DataFrame:
    """Blocks (doc_id, page, ord, text, kind, bbox) of the text layers of PDF files (path, content): lines tells page, text
    and box of each line; specks and what repeats on most pages go. Files that aren't PDF have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, page, k, text, "text", _box(box)) for p, c in zip(b["path"], b["content"]) if c is not None and bytes(c[:4]) == b"%PDF" for k, (page, text, box) in enumerate(lines(bytes(c)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord", "text", "kind", "bbox"])

    found = files.select("path", "content").mapInPandas(run, f"doc_id string, page int, ord int, text string, kind string, bbox {layout.BOX}")
    return layout.drop_furniture(layout.text_layer(found))


_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 li p td th".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Words(HTMLParser):
    """Words with pixel boxes, by the outermost block that holds them; a word outside of any stands for itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.words: list[dict] = []
        self.n = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.n += 1
        holder = next((i for t, i in self.open if t in _BLOCKS), self.n)
        if (box := dict(attrs).get("data-bbox")) is not None:
            try:
                x = [float(v) for v in box.split()]
            except ValueError:
                x = []
            if len(x) == 4:
                self.words.append({"of": holder, "box": x, "text": "", "depth": len(self.open), "open": tag not in _VOID})
        if tag not in _VOID:
            self.open.append((tag, self.n))

    def handle_endtag(self, tag: str) -> None:
        if tag in (t for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            for w in self.words:
                w["open"] &= w["depth"] < len(self.open)

    def handle_data(self, data: str) -> None:
        for w in self.words:
            if w["open"]:
                w["text"] += data


def words_to_blocks(html: str, width: float, height: float) -> str:
    """HTML whose words have boxes in pixels as HTML whose blocks have boxes on a grid of a thousand, for page_blocks.
    Without the size of the image it stays as it is."""
    if width <= 0 or height <= 0:
        return html
    page = _Words()
    page.feed(html)
    page.close()
    groups: dict[int, list[dict]] = {}
    for w in page.words:
        groups.setdefault(w["of"], []).append(w)
    out = []
    for own in groups.values():
        if text := " ".join(t for w in own if (t := w["text"].strip())):
            xs, ys = [v for w in own for v in w["box"][::2]], [v for w in own for v in w["box"][1::2]]
            grid = [int(v * 1000 / size + 0.5) for v, size in ((min(xs), width), (min(ys), height), (max(xs), width), (max(ys), height))]
            out.append(f'<div data-bbox="{" ".join(map(str, grid))}" data-label="text">{escape(text, quote=False)}</div>')
    return "\n".join(out)
