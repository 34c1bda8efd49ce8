"""Pages from several engines: parsed documents flattened, tables as rows, replies cleaned, and each page's best parse."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import describe_grid
from .pixels import respace_blocks, snap_blocks

T = TypeVar("T")


def flatten(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, ord, kind, text, page, bbox) as blocks: of equal ones the first, tables after all else, ord anew."""
    same = Window.partitionBy("doc_id", "kind", "text", "page", "bbox").orderBy("ord")
    once = nodes.withColumn("kind", F.coalesce("kind", F.lit("text"))).withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")
    order = Window.partitionBy("doc_id").orderBy(F.col("kind") == "table", "ord")
    return once.withColumn("ord", F.row_number().over(order) - 1)


def table_row_blocks(cells: DataFrame) -> DataFrame:
    """(grid_id, row, text, l, t, r, b) of cells (grid_id, row, col, row_span, header, text, color, bbox), those that span
    standing once, at their origin: a self-labelled line for each row below the header, its box the union of its cells'
    boxes, cut to the height of the cells of that row alone."""
    lines = describe_grid(cells)
    top, low = F.greatest("bbox.t", "bbox.b"), F.least("bbox.t", "bbox.b")
    single = F.coalesce("row_span", F.lit(1)) == 1
    boxes = cells.where("bbox IS NOT NULL").groupBy("grid_id", "row").agg(
        F.min("bbox.l").alias("l"), F.max("bbox.r").alias("r"), F.max(top).alias("_t"), F.min(low).alias("_b"), F.max(F.when(single, top)).alias("_st"), F.min(F.when(single, low)).alias("_sb")
    )
    cut = boxes.select("grid_id", "row", "l", F.coalesce("_st", "_t").alias("t"), "r", F.coalesce("_sb", "_b").alias("b"))
    return lines.withColumnRenamed("line", "text").join(cut, ["grid_id", "row"], "left").select("grid_id", "row", "text", "l", "t", "r", "b")


def reply_text(c: Column) -> Column:
    """The page in a vision model's reply: no chat tokens, thinking or fence; null where nothing is left."""
    bare = F.regexp_replace(F.substring_index(c, "<|im_end|>", 1), r"(?s)<\|[^|>]*\|>|<think>.*?</think>", "")
    inner = F.trim(F.regexp_replace(F.trim(bare), r"(?s)^```\w*\s*|\s*```$", ""))
    return F.when(inner != "", inner)


def offset(blocks: DataFrame, dy: float) -> DataFrame:
    """Boxes of a tile moved up by dy, to where the tile lies on its page."""
    moved = F.struct(F.col("bbox.l").alias("l"), (F.col("bbox.t") + dy).alias("t"), F.col("bbox.r").alias("r"), (F.col("bbox.b") + dy).alias("b"))
    return blocks.withColumn("bbox", F.when(F.col("bbox").isNotNull(), moved))


def word_boxes(words: DataFrame, width: Column, height: Column) -> DataFrame:
    """(page_id, group, text, x0, y0, x1, y1) of words (page_id, group, ord, text, x0, y0, x1, y1) in pixels: one block for
    each group, on a grid of a thousand, rounded half up."""
    grid = lambda v, size: F.floor(v * 1000 / size + 0.5).cast("int")
    scaled = words.select("page_id", "group", "ord", "text", grid(F.col("x0"), width).alias("x0"), grid(F.col("y0"), height).alias("y0"), grid(F.col("x1"), width).alias("x1"), grid(F.col("y1"), height).alias("y1"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    out = scaled.groupBy("page_id", "group").agg(rows.alias("_r"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.select("page_id", "group", F.array_join(F.transform("_r", lambda r: r["text"]), " ").alias("text"), "x0", "y0", "x1", "y1")


def routed_blocks(base: DataFrame, routes: DataFrame, mineru: DataFrame, vlm: DataFrame, pipeline: str = "auto") -> DataFrame:
    """Blocks (doc_id, page, ord, text, ...) of the engine to which each page (doc_id, page, route) goes, with engine. A
    page of mineru without blocks goes to vlm; where vlm has none either the rejected parse stays, engine 'rejected'.
    pipeline='vlm' sends every page to vlm. A page of base without a route is fast."""
    page = ["doc_id", "page"]
    have = lambda df, name: df.select(*page).distinct().withColumn(name, F.lit(True))
    routed = base.select(*page).distinct().join(routes.select(*page, "route"), page, "full_outer").withColumn("route", F.lit("vlm") if pipeline == "vlm" else F.coalesce("route", F.lit("fast")))
    way = routed.select(*page, "route").join(have(mineru, "_m"), page, "left").join(have(vlm, "_v"), page, "left")
    engine = F.when(F.col("route") == "fast", "fast").when((F.col("route") == "mineru") & F.coalesce("_m", F.lit(False)), "mineru").when(F.coalesce("_v", F.lit(False)), "vlm").otherwise("rejected")
    chosen = way.select(*page, engine.alias("engine"))
    of = lambda df, *names: df.join(chosen.where(F.col("engine").isin(*names)), page)
    return of(base, "fast", "rejected").unionByName(of(mineru, "mineru")).unionByName(of(vlm, "vlm"))


def with_color(text: Column, color: Column, boxed: Column, longest: int = 60) -> Column:
    """Short boxed texts are followed by their background's name."""
    return F.when(boxed & color.isNotNull() & (F.length(text) <= longest), F.concat(text, F.lit(" ["), color, F.lit("]"))).otherwise(text)


def cell_color(text: Column, legend: Column, palette: Column) -> Column:
    """What a cell's colour means: a legend entry's label only where the cell has no text of its own to speak of (three
    characters at most), else the colour's name."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) <= 3, F.coalesce(legend, palette)).otherwise(palette)


def reconcile(blocks: DataFrame, words: DataFrame, rasters: DataFrame) -> DataFrame:
    """Boxes moved onto the ink of their pages, then fused capitals spaced by the words of their pages; blocks of pages
    without a raster or words stay as they are."""
    return respace_blocks(snap_blocks(blocks, rasters), words)


def is_swatch(text: Column, boxed: Column, saturated: Column) -> Column:
    """A legend entry: boxed, 1 to 60 characters, no heading, on a saturated colour."""
    return boxed & F.length(text).between(1, 60) & ~text.rlike("[:：]$") & saturated


def resilient(work: Callable[[], T], attempts: int = 3, pause: float = 0.5, fatal: tuple[type[BaseException], ...] = (TimeoutError,)) -> T:
    """work, tried again after growing pauses; deadlines aren't tried again."""
    for k in range(attempts):
        try:
            return work()
        except fatal:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError("unreachable")
