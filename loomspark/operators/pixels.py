"""Page rasters and words: fill colours of cells, boxes moved onto their ink, fused capitals spaced again."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import color_name

FUSED = 6
INK_CONTRAST = 40


def _samples(pixels: bytes, comps: int) -> np.ndarray:
    flat = np.frombuffer(pixels, np.uint8)
    return flat[: len(flat) // comps * comps].reshape(-1, comps)[::2, :3].astype(np.int64)


def dominant(pixels: bytes, comps: int, least: int = 8, saturation: int = 28) -> tuple[int, int, int] | None:
    """The mean of the fullest bucket (32 steps wide) of saturated samples, every other pixel being one."""
    if comps < 3:
        return None
    s = _samples(pixels, comps)
    s = s[s.max(1) - s.min(1) >= saturation] if len(s) else s
    if not len(s):
        return None
    keys, first, inverse, counts = np.unique((s // 32) @ np.array([64, 8, 1]), return_index=True, return_inverse=True, return_counts=True)
    best = min(range(len(keys)), key=lambda k: (-counts[k], first[k]))
    if counts[best] < least:
        return None
    return tuple(int(x) for x in np.floor(s[inverse == best].mean(0) + 0.5))  # type: ignore[return-value]


def neutral(pixels: bytes, comps: int, least: int = 8, away: int = 12) -> tuple[int, int, int] | None:
    """The mean of samples that are neither ink nor paper, if it differs from white."""
    if comps < 3:
        return None
    s = _samples(pixels, comps)
    lum = s.mean(1) if len(s) else np.zeros(0)
    s = s[(lum > 60) & (lum < 250)]
    if len(s) < least:
        return None
    mean = np.floor(s.mean(0) + 0.5)
    return tuple(int(x) for x in mean) if 255 - mean.max() >= away else None  # type: ignore[return-value]


def fill_color(pixels: Column, comps: Column) -> Column:
    """(r, g, b) of a cell's crop: its dominant colour, else its neutral fill, else null."""

    @F.pandas_udf("r int, g int, b int")
    def fill(planes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        found = [None if p is None else dominant(bytes(p), int(c)) or neutral(bytes(p), int(c)) for p, c in zip(planes, counts)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["r", "g", "b"], dtype="Int32")

    return fill(pixels, comps)


def cell_color_name(pixels: Column, comps: Column) -> Column:
    """The name of a cell's fill colour, null where it has none or a grey one."""
    c = fill_color(pixels, comps)
    return color_name(c["r"], c["g"], c["b"])


def nearest_label(colors: DataFrame, legend: DataFrame, most: int = 3000) -> DataFrame:
    """colors (id, r, g, b) with the label of the nearest legend entry (label, r, g, b) within the squared distance."""
    d = sum((F.col(f"c.{x}") - F.col(f"l.{x}")) * (F.col(f"c.{x}") - F.col(f"l.{x}")) for x in "rgb")
    near = colors.alias("c").crossJoin(legend.alias("l")).select("c.id", "l.label", d.alias("d")).where(F.col("d") <= most)
    return colors.join(near.groupBy("id").agg(F.min_by("label", F.struct("d", "label")).alias("label")), "id", "left")


def respace(text: str | None, words: Iterable[str]) -> str | None:
    """Each run of six capitals or more becomes the first sequence of page words, two at least of two letters at least,
    that makes it up."""
    if not text:
        return text
    page = [w for w in words if w]

    def mend(m: re.Match) -> str:
        for i in range(len(page)):
            built, k = "", i
            while k < len(page) and len(page[k]) >= 2 and m[0].startswith(built + page[k]):
                built, k = built + page[k], k + 1
                if built == m[0] and k - i >= 2:
                    return " ".join(page[i:k])
        return m[0]

    return re.sub(r"[^\W\d_a-z]{6,}", lambda m: mend(m) if m[0].isupper() else m[0], text)


def respace_blocks(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """blocks with their text spaced by the words (doc_id, page, words array<string>) of their page."""

    @F.pandas_udf("string")
    def spaced(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([respace(t, w if w is not None else []) for t, w in zip(texts, lists)], dtype="object")

    fused = F.col("text").rlike(r"\p{Lu}{6,}")
    return blocks.join(words, ["doc_id", "page"], "left").withColumn("text", F.when(fused, spaced("text", "words")).otherwise(F.col("text"))).drop("words")


def snap(gray: np.ndarray, top: int, bottom: int, left: int, right: int) -> int | None:
    """How far to move a box down (up if negative) so that it has ink: 0 if it has, None if there is none near."""
    height = max(1, bottom - top)

    def contrast(dy: int) -> int:
        part = gray[max(0, top + dy) : max(0, bottom + dy), max(0, left) : max(0, right)]
        return int(part.max()) - int(part.min()) if part.size else 0

    if contrast(0) > INK_CONTRAST:
        return 0
    shifts = [s for d in range(2, int(1.5 * height) + 1, 2) for s in (d, -d)]
    best = max(shifts, key=contrast, default=0)
    return best if contrast(best) > INK_CONTRAST else None


def snap_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks (doc_id, page, ord, bbox in pixels from the top) moved onto ink of pages (doc_id, page, width, height,
    gray binary); a box with no ink near loses its box, unless the whole page is blank."""

    @F.pandas_udf("double")
    def shift(gray: pd.Series, width: pd.Series, height: pd.Series, left: pd.Series, top: pd.Series, right: pd.Series, bottom: pd.Series) -> pd.Series:
        out: list[float | None] = []
        for g, w, h, x0, y0, x1, y1 in zip(gray, width, height, left, top, right, bottom):
            if g is None or pd.isna(x0):
                out.append(0.0)
                continue
            plane = np.frombuffer(g, np.uint8).reshape(int(h), int(w))
            if int(plane.max()) - int(plane.min()) <= INK_CONTRAST:
                out.append(0.0)
                continue
            out.append(snap(plane, int(min(y0, y1)), int(max(y0, y1)), int(x0), int(x1)))
        return pd.Series(out, dtype="float64")

    b = blocks.join(pages, ["doc_id", "page"], "left").withColumn("_dy", shift("gray", "width", "height", "bbox.l", "bbox.t", "bbox.r", "bbox.b"))
    moved = F.struct(F.col("bbox.l").alias("l"), (F.col("bbox.t") + F.col("_dy")).alias("t"), F.col("bbox.r").alias("r"), (F.col("bbox.b") + F.col("_dy")).alias("b"))
    return b.withColumn("bbox", F.when(F.col("bbox").isNotNull() & F.col("_dy").isNotNull(), moved)).drop("_dy", "gray", "width", "height")
