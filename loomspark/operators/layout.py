"""Blocks with page geometry: markdown and offsets, regions of a span, page furniture, boxes and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n"
BOX = "struct<l:double,t:double,r:double,b:double>"


def text_blocks(docs: DataFrame, separator: str = r"\n{2,}") -> DataFrame:
    """(doc_id, ord, text): the non-empty paragraphs of each text, trimmed, ord from 0."""
    from loomspark.functions.text import js_trim

    pieces = F.filter(F.transform(F.split(F.col("text"), separator), js_trim), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(pieces).alias("ord", "text"))


def markdown_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): the blocks of each document joined by blank lines, in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks.groupBy("doc_id").agg(rows.alias("_r")).select("doc_id", F.array_join(F.transform("_r", lambda r: r["text"]), SEPARATOR).alias("markdown"))


def position_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with span_start and span_end, their offsets in the markdown."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(SEPARATOR)).over(before), F.lit(0))
    return blocks.withColumn("span_start", start.cast("bigint")).withColumn("span_end", (F.col("span_start") + F.length("text")).cast("bigint"))


def line_height(positioned: DataFrame) -> DataFrame:
    """(doc_id, line_height): of the box heights, sorted and cut at the largest ratio beyond 1.8 of neighbours (the first
    of equals), the one a quarter up the lower part: tall boxes of several lines hardly move it. No row without boxes."""
    h = positioned.select("doc_id", "ord", (F.col("bbox.t") - F.col("bbox.b")).alias("_d")).select("doc_id", "ord", F.abs("_d").alias("h")).where("h > 0")
    w = Window.partitionBy("doc_id").orderBy("h", "ord")
    step = h.withColumn("i", F.row_number().over(w) - 1).withColumn("ratio", F.col("h") / F.lag("h").over(w))
    cut = step.where("ratio > 1.8").groupBy("doc_id").agg(F.max_by("i", F.struct("ratio", -F.col("i"))).alias("cut"))
    size = step.groupBy("doc_id").agg(F.count("*").alias("n")).join(cut, "doc_id", "left").select("doc_id", F.floor(F.coalesce("cut", "n") / 4).alias("at"))
    return step.join(size, "doc_id").where("i = at").select("doc_id", F.col("h").alias("line_height"))


def span_regions(spans: DataFrame, positioned: DataFrame, bucket: int = 4096) -> DataFrame:
    """(span_id, doc_id, ord, overlap_start, overlap_end): the blocks that each half-open span (span_id, doc_id, start,
    end) meets. Both sides are cut into buckets of characters, so long documents don't join quadratically."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(F.greatest(a, b - 1) / bucket)))
    s = spans.select("span_id", "doc_id", "start", "end", cells(F.col("start"), F.col("end")).alias("_c"))
    b = positioned.select("doc_id", "ord", "span_start", "span_end", cells(F.col("span_start"), F.col("span_end")).alias("_c"))
    met = s.join(b, ["doc_id", "_c"]).where("span_start < end AND span_end > start")
    first = F.floor(F.greatest("start", "span_start") / bucket)  # a pair counts in the first bucket that both share
    return met.where(F.col("_c") == first).select("span_id", "doc_id", "ord", F.greatest("start", "span_start").alias("overlap_start"), F.least("end", "span_end").alias("overlap_end"))


def clip_regions(met: DataFrame, positioned: DataFrame, heights: DataFrame) -> DataFrame:
    """(span_id, doc_id, ord, page, bbox): of each met block the part of its box that the span covers. A line is cut to
    the share of its characters, unless that is nearly all or too narrow; several lines keep their box."""
    b = positioned.select("doc_id", "ord", "page", "text", "bbox", "span_start", "span_end").where("bbox IS NOT NULL AND trim(text) <> ''")
    j = met.join(b, ["doc_id", "ord"]).join(heights, "doc_id", "left")
    size = F.greatest(F.col("span_end") - F.col("span_start"), F.lit(1))
    f0, f1 = (F.col("overlap_start") - F.col("span_start")) / size, (F.col("overlap_end") - F.col("span_start")) / size
    room = F.col("bbox.r") - F.col("bbox.l")
    x0, x1 = F.col("bbox.l") + f0 * room, F.col("bbox.l") + f1 * room
    tall = F.abs(F.col("bbox.t") - F.col("bbox.b"))
    single = (F.coalesce("line_height", F.lit(0.0)) <= 0) | (tall <= 1.5 * F.col("line_height"))
    whole = ((f0 <= 0.02) & (f1 >= 0.98)) | ~single | (room <= 6) | (x1 - x0 < 6) | (x1 - x0 < 0.05 * room)
    cut = F.struct(x0.alias("l"), F.col("bbox.t").alias("t"), x1.alias("r"), F.col("bbox.b").alias("b"))
    return j.select("span_id", "doc_id", "ord", "page", F.when(whole, F.col("bbox")).otherwise(cut).alias("bbox"))


def merge_regions(regions: DataFrame, keys: tuple[str, ...] = ("span_id", "page")) -> DataFrame:
    """(keys, part, boxes, l, t, r, b): boxes of a page whose centres lie within four line heights form one region; of
    several, single stray boxes go unless none is larger."""
    top, low = F.greatest("bbox.t", "bbox.b"), F.least("bbox.t", "bbox.b")
    rows = regions.select(*keys, "ord", "bbox", top.alias("_t"), low.alias("_b")).withColumn("_c", (F.col("_t") + F.col("_b")) / 2)
    w, every = Window.partitionBy(*keys).orderBy("_c", "ord"), Window.partitionBy(*keys)
    heights = F.array_sort(F.collect_list(F.col("_t") - F.col("_b")).over(every))
    lh = F.get(heights, F.floor(F.size(heights) / 2).cast("int"))
    marked = rows.withColumn("_lh", lh).withColumn("_new", ((F.col("_lh") > 0) & (F.col("_c") - F.lag("_c").over(w) > 4 * F.col("_lh"))).cast("int"))
    parts = marked.withColumn("part", F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("int"))
    upright = F.min_by(F.col("bbox.t") >= F.col("bbox.b"), "ord")
    boxes = parts.groupBy(*keys, "part").agg(F.count("*").alias("boxes"), F.min("bbox.l").alias("l"), F.max("bbox.r").alias("r"), F.max("_t").alias("_hi"), F.min("_b").alias("_lo"), upright.alias("_up"))
    most = F.max("boxes").over(every)
    kept = boxes.withColumn("_m", most).where("boxes >= 2 OR boxes = _m")
    return kept.select(*keys, "part", "boxes", "l", F.when(F.col("_up"), F.col("_hi")).otherwise(F.col("_lo")).alias("t"), "r", F.when(F.col("_up"), F.col("_lo")).otherwise(F.col("_hi")).alias("b"))


def geometry_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, geometry): grid if a block has a cell, else spatial if one has a box, else none."""
    return blocks.groupBy("doc_id").agg(F.when(F.bool_or(F.col("cell").isNotNull()), "grid").when(F.bool_or(F.col("bbox").isNotNull()), "spatial").otherwise("none").alias("geometry"))


def to_bottom_left(box: Column, height: Column, origin: Column | None = None) -> Column:
    """Boxes with y growing downward, by their own y or by an origin that says TOPLEFT, are turned over, if the page height
    is known."""
    down = box["t"] < box["b"]
    if origin is not None:
        down = down | F.coalesce(origin == "TOPLEFT", F.lit(False))
    flip = down & (F.coalesce(height, F.lit(0.0)) > 0)
    turned = F.struct(box["l"].alias("l"), (height - box["t"]).alias("t"), box["r"].alias("r"), (height - box["b"]).alias("b"))
    return F.when(flip, turned).otherwise(box)


def drop_furniture(blocks: DataFrame, least_pages: int = 3) -> DataFrame:
    """blocks (doc_id, page, text, bbox, ...) without boxed texts that repeat, in place (to 5 points), on half the pages
    of a document or more, and on 3 at least; documents of fewer pages stay whole."""
    place = F.concat_ws("|", "text", *[F.floor(F.col(f"bbox.{c}") / 5 + 0.5).cast("string") for c in "ltrb"])
    keyed = blocks.withColumn("_key", F.when(F.col("bbox").isNotNull(), place))
    pages = keyed.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    often = keyed.where("_key IS NOT NULL").groupBy("doc_id", "_key").agg(F.count_distinct("page").alias("_on")).join(pages, "doc_id")
    gone = often.where((F.col("_pages") >= least_pages) & (F.col("_on") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") / 2)))).select("doc_id", "_key")
    return keyed.join(gone, ["doc_id", "_key"], "left_anti").drop("_key")


def is_geometryless(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, geometryless): a page that is one block with text and without a box, so worth reading in tiles."""
    whole = F.coalesce(F.bool_and(F.col("bbox").isNull() & (F.trim("text") != "")), F.lit(False))
    return blocks.groupBy("doc_id", "page").agg(((F.count("*") == 1) & whole).alias("geometryless"))


def text_layer(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, ord, text, bbox) without specks: boxes under 2 points, texts of combining marks alone, and
    texts of one or two characters that lie mostly inside a larger line of their page."""
    wide, tall = F.col("bbox.r") - F.col("bbox.l"), F.abs(F.col("bbox.t") - F.col("bbox.b"))
    some = lines.where((wide >= 2) & (tall >= 2) & (F.trim("text") != "") & ~F.col("text").rlike(r"^\p{Mn}+$"))
    area = lambda a: (F.col(f"{a}.bbox.r") - F.col(f"{a}.bbox.l")) * F.abs(F.col(f"{a}.bbox.t") - F.col(f"{a}.bbox.b"))
    over = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    top = lambda a: F.greatest(f"{a}.bbox.t", f"{a}.bbox.b")
    low = lambda a: F.least(f"{a}.bbox.t", f"{a}.bbox.b")
    shared = over(F.greatest("s.bbox.l", "g.bbox.l"), F.least("s.bbox.r", "g.bbox.r")) * over(F.greatest(low("s"), low("g")), F.least(top("s"), top("g")))
    share = F.when(F.length("s.text") == 1, 0.3).otherwise(0.6)
    inside = (F.col("s.doc_id") == F.col("g.doc_id")) & (F.col("s.page") == F.col("g.page")) & (F.col("s.ord") != F.col("g.ord")) & (area("g") > area("s")) & (shared > share * area("s"))
    small = some.where(F.length("text") <= 2).alias("s").join(some.alias("g"), inside, "left_semi").select("doc_id", "page", "ord")
    return some.join(small, ["doc_id", "page", "ord"], "left_anti")


def collapse_loops(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Runs of least or more consecutive blocks with the same text and box become their first; shorter ones stay."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    new = (~(F.col("text").eqNullSafe(F.lag("text").over(w)) & F.col("bbox").eqNullSafe(F.lag("bbox").over(w)))).cast("int")
    runs = blocks.withColumn("_run", F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(new)).over(w))
    own = Window.partitionBy("doc_id", "_run")
    return runs.withColumn("_n", F.count("*").over(own)).withColumn("_k", F.row_number().over(own.orderBy("ord"))).where(f"_n < {least} OR _k = 1").drop("_run", "_n", "_k")


def is_degenerate_ocr(blocks: DataFrame) -> DataFrame:
    """(doc_id, degenerate): a page of 12 texts or more of which fewer than six in ten are distinct."""
    some = blocks.where("trim(text) <> ''").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("d"))
    return some.select("doc_id", ((F.col("n") >= 12) & (F.col("d") / F.col("n") < 0.6)).alias("degenerate"))


def describe_grid(cells: DataFrame) -> DataFrame:
    """(grid_id, row, line) of cells (grid_id, row, col, header, text, color): a line for each row below the header.

    The header ends at the first row without a header cell; where each row has one (or there is none) one row, if there
    are two. A column's header is, of each header row, the nearest text at or left of it, equal neighbours once, joined
    by a middle dot. The first column stands bare, others as header: value, with their colour in brackets."""
    grid = cells.select("grid_id", "row", "col", "header", F.coalesce("text", F.lit("")).alias("text"), "color")
    rows = grid.groupBy("grid_id", "row").agg(F.bool_or(F.coalesce("header", F.lit(False))).alias("has"))
    size = rows.groupBy("grid_id").agg(F.max("row").alias("last"), F.min(F.when(~F.col("has"), F.col("row"))).alias("end"))
    ends = size.select("grid_id", F.when(F.col("end").isNull() | (F.col("end") == 0), F.least(F.lit(1), F.col("last"))).otherwise(F.col("end")).alias("_end"))
    carried = F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(Window.partitionBy("grid_id", "row").orderBy("col"))
    marked = grid.join(ends, "grid_id")
    columns = marked.select("grid_id", "col").distinct()
    head_rows = marked.where("row < _end").select("grid_id", "row").distinct()
    dense = head_rows.join(columns, "grid_id").join(marked.select("grid_id", "row", "col", "text"), ["grid_id", "row", "col"], "left")
    heads = dense.withColumn("h", carried).where("h IS NOT NULL").groupBy("grid_id", "col").agg(F.array_sort(F.collect_list(F.struct("row", "h"))).alias("hs"))
    named = F.filter(F.transform("hs", lambda x, i: F.when((i == 0) | (F.get(F.col("hs"), F.greatest(i - 1, F.lit(0)))["h"] != x["h"]), x["h"])), lambda x: x.isNotNull())
    body = marked.where("row >= _end AND (text <> '' OR color IS NOT NULL)").join(heads.select("grid_id", "col", F.array_join(named, " · ").alias("head")), ["grid_id", "col"], "left")
    tint = F.when(F.col("color").isNotNull(), F.concat(F.lit(" ["), "color", F.lit("]"))).otherwise("")
    head = F.coalesce("head", F.lit(""))
    value = F.when((F.col("col") == 0) | (head == ""), F.col("text")).when(F.col("text") == "", head).otherwise(F.concat(head, F.lit(": "), "text"))
    lines = body.select("grid_id", "row", "col", F.concat(value, tint).alias("v")).groupBy("grid_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("vs"))
    return lines.select("grid_id", "row", F.array_join(F.transform("vs", lambda x: x["v"]), " │ ").alias("line")).where("line <> ''")


def route_counts(routes: DataFrame, by: str) -> DataFrame:
    return routes.groupBy(by, "route").agg(F.count("*").alias("n"))
