"""Chunks: table rows with their header, prose by one of several splitters, and where a chunk lies in its text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import layout
from .shared import spread

MOST_CHUNKS = 50_000


def segmentize(positioned: DataFrame) -> DataFrame:
    """positioned blocks with segment, is_table and caption: runs of table and of other blocks; a caption right before a
    table belongs to it and leaves the prose."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    kind = F.coalesce("kind", F.lit("text"))
    marked = positioned.withColumn("is_table", kind == "table")
    marked = marked.withColumn("_cap", (F.lower(kind) == "caption") & F.coalesce(F.lead("is_table").over(w), F.lit(False)))
    caption = F.when(F.lag("_cap").over(w) & F.col("is_table"), F.lag("text").over(w))
    marked = marked.withColumn("caption", caption).where("NOT _cap").drop("_cap")
    new = F.coalesce((F.col("is_table") != F.lag("is_table").over(w)) | F.col("caption").isNotNull(), F.lit(True)).cast("int")
    return marked.withColumn("segment", F.sum(new).over(w).cast("int"))


def table_chunks(segments: DataFrame) -> DataFrame:
    """(doc_id, segment, part, span_start, span_end, text) of the table segments: part 0 is the whole table, part n its
    n-th row after the first, which it repeats, with the caption, unless it labels itself. One row makes part 0 alone."""
    t = segments.where("is_table")
    own, order = Window.partitionBy("doc_id", "segment"), Window.partitionBy("doc_id", "segment").orderBy("ord")
    full = t.groupBy("doc_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_r"), F.max("caption").alias("_c"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")
    )
    whole = full.select("doc_id", "segment", F.lit(0).alias("part"), "span_start", "span_end", F.concat_ws("\n", "_c", F.array_join(F.transform("_r", lambda r: r["text"]), "\n")).alias("text"))
    rows = t.withColumn("part", F.row_number().over(order) - 1).withColumn("_c", F.max("caption").over(own)).withColumn("_first", F.first("text").over(order)).withColumn("_self", F.first(F.coalesce("self_labeled", F.lit(False))).over(order))
    each = rows.where("part > 0").select("doc_id", "segment", "part", "span_start", "span_end", F.concat_ws("\n", "_c", F.when(~F.col("_self"), F.col("_first")), "text").alias("text"))
    return whole.unionByName(each)


# ---------------------------------------------------------------- splitters


def character(text: str, size: int, overlap: int) -> list[str]:
    step = max(1, size - overlap)
    return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step) if text[i : i + size]]


def _packed(pieces: list[str], size: int, overlap: int, measure: Callable[[str], int] = len) -> list[str]:
    """Consecutive pieces joined up to size; a new chunk begins with the last pieces within overlap."""
    out: list[str] = []
    held: list[str] = []
    for p in pieces:
        if held and measure("".join([*held, p])) > size:
            out.append("".join(held))
            while held and (measure("".join(held)) > overlap or measure("".join([*held, p])) > size):
                held.pop(0)
        held.append(p)
    return [s for s in (x.strip() for x in [*out, "".join(held)]) if s]


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces between separators, finer ones where a piece is too long, packed up to size."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []

    def cut(part: str, seps: tuple[str, ...]) -> list[str]:
        if len(part) <= size:
            return [part]
        if not seps:
            return [part[i : i + size] for i in range(0, len(part), size)]
        return [q for p in re.split(f"(?<={re.escape(seps[0])})", part) if p for q in cut(p, seps[1:])]

    return _packed(cut(text, separators), size, overlap)


def sentence(text: str, size: int, overlap: int) -> list[str]:
    return [c for s in _packed(re.split(r"(?<=[.!?。！？])(?=\s)", text), size, overlap) for c in ([s] if len(s) <= size else recursive(s, size, overlap))]


def token(text: str, size: int, overlap: int) -> list[str]:
    return _packed(re.findall(r"\S+\s*", text), size, overlap, lambda s: len(s.split()))


def markdown(text: str, size: int, overlap: int) -> list[str]:
    return [c for part in re.split(r"(?m)^(?=#{1,6} )", text) if part.strip() for c in recursive(part, size, overlap)]


SPLITTERS = {"character": character, "recursive": recursive, "sentence": sentence, "token": token, "markdown": markdown}


def locate(text: str, chunks: list[str], overlap: int = 0) -> list[tuple[int, int]]:
    """[start, end) of each chunk, looked for after the one before it; white space may differ; (-1, -1) if not there."""
    out, cursor = [], 0
    for c in chunks:
        start = text.find(c, cursor)
        end = start + len(c)
        if start < 0:
            m = re.compile(r"\s+".join(map(re.escape, c.split()))).search(text, cursor) if c.split() else None
            start, end = m.span() if m else (-1, -1)
        out.append((start, end))
        if start >= 0:
            cursor = start + max(1, end - start - overlap)
    return out


def split_texts(texts: DataFrame, strategy: str = "recursive", size: int = 800, overlap: int = 100, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, ord, span_start, span_end, text) of texts (keys, text): a map over rows. An unknown strategy is
    recursive; 'semantic', which needs a service, is character of 400 and 120 without one. A chunk that isn't found in its
    text has span (-1, -1)."""
    if not 1 <= size <= 8000 or not 0 <= overlap <= 4000:
        raise ValueError("size must be 1..8000 and overlap 0..4000")
    if strategy == "semantic":
        strategy, size, overlap = "character", 400, 120
    split = SPLITTERS.get(strategy, recursive)
    kinds = ", ".join(f"{k} {dict(texts.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *own, t in zip(*[b[k] for k in keys], b["text"]):
                chunks = split(t, size, overlap) if t else []
                if len(chunks) > MOST_CHUNKS:
                    raise ValueError(f"document {own[0]} makes more than {MOST_CHUNKS} chunks")
                for k, (c, (s, e)) in enumerate(zip(chunks, locate(t, chunks, overlap) if chunks else [])):
                    rows.append((*own, k, s, e, c if s < 0 else t[s:e]))
            yield pd.DataFrame(rows, columns=[*keys, "ord", "span_start", "span_end", "text"])

    return spread(texts.select(*keys, "text")).mapInPandas(run, f"{kinds}, ord int, span_start bigint, span_end bigint, text string")


#: Changes where chunks would come out differently: part of the key under which they are kept.
CHUNKER_VERSION = "loom-chunks-2"


def sealed(chunks: DataFrame) -> DataFrame:
    """chunks with checksum and rank, a string that sorts as ord does."""
    return chunks.withColumn("checksum", F.sha2("text", 256)).withColumn("rank", F.lpad(F.lower(F.hex("ord")), 6, "0"))


def structural_chunks(positioned: DataFrame) -> DataFrame:
    """One chunk for each block."""
    return sealed(positioned.select("doc_id", "ord", "span_start", "span_end", "text"))


def character_windows(texts: DataFrame, size: int = 400, overlap: int = 120, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The character strategy without Python: (keys, ord, span_start, span_end, text)."""
    step = size - overlap
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(step)))
    some = texts.where("length(text) > 0").select(*keys, "text", F.posexplode(starts).alias("ord", "_s"))
    end = F.least(F.col("_s") + size, F.length("text"))
    return some.select(*keys, "ord", F.col("_s").cast("bigint").alias("span_start"), end.cast("bigint").alias("span_end"), F.substring("text", F.col("_s") + 1, F.lit(size)).alias("text"))


def prose_runs(segments: DataFrame) -> DataFrame:
    """(doc_id, segment, run_start, text): the slice of the markdown that a run of blocks between tables takes."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    runs = segments.where("NOT is_table").groupBy("doc_id", "segment").agg(F.min("span_start").alias("run_start"), rows.alias("_r"))
    return runs.select("doc_id", "segment", "run_start", F.array_join(F.transform("_r", lambda r: r["text"]), layout.SEPARATOR).alias("text"))


def prose_chunks(segments: DataFrame, strategy: str = "recursive", size: int = 800, overlap: int = 100) -> DataFrame:
    """(doc_id, segment, part, span_start, span_end, text): each prose run split, spans counted in the markdown."""
    if strategy == "semantic":
        strategy, size, overlap = "character", 400, 120
    keys = ("doc_id", "segment", "run_start")
    cut = character_windows(prose_runs(segments), size, overlap, keys) if strategy == "character" else split_texts(prose_runs(segments), strategy, size, overlap, keys)
    moved = lambda c: F.when(F.col("span_start") >= 0, F.col(c) + F.col("run_start")).otherwise(F.lit(-1)).cast("bigint").alias(c)
    return cut.select("doc_id", "segment", F.col("ord").alias("part"), moved("span_start"), moved("span_end"), "text")


def regions_of(spans: DataFrame, positioned: DataFrame) -> DataFrame:
    """(doc_id, ord, regions): page and box of what each span (doc_id, ord, span_start, span_end) covers, in block order;
    spans that cover nothing, or aren't known (-1), have no row."""
    asked = spans.where("span_start >= 0").select(F.struct("doc_id", "ord").alias("span_id"), "doc_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    clipped = layout.clip_regions(layout.span_regions(asked, positioned), positioned, layout.line_height(positioned))
    rows = F.array_sort(F.collect_list(F.struct("ord", "page", "bbox")))
    found = clipped.groupBy("span_id").agg(rows.alias("_r"))
    return found.select("span_id.doc_id", "span_id.ord", F.transform("_r", lambda r: F.struct(r["page"].alias("page"), r["bbox"].alias("bbox"))).alias("regions"))


def remap_span(spans: DataFrame, markdown: DataFrame, positioned: DataFrame) -> DataFrame:
    """spans (doc_id, ord, span_start, span_end, text) with checksum and regions; a null text is the slice of the markdown
    (doc_id, markdown), a span of -1 has no regions."""
    full = spans.join(markdown, "doc_id", "left").withColumn("text", F.coalesce("text", F.substring("markdown", F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int")))).drop("markdown")
    return full.withColumn("checksum", F.sha2("text", 256)).join(regions_of(spans, positioned), ["doc_id", "ord"], "left").withColumn("regions", F.coalesce("regions", F.array().cast(f"array<struct<page:int,bbox:{layout.BOX}>>")))


def build_chunks(blocks: DataFrame, strategy: str = "recursive", size: int = 800, overlap: int = 100) -> DataFrame:
    """(doc_id, ord, rank, span_start, span_end, text, checksum, regions): all chunks of the documents, in reading order.

    Blocks (doc_id, ord, text, kind, self_labeled, page, bbox) give one chunk each by the strategies structural and
    hierarchical; else tables give a chunk of the whole and one a row, and the prose between them what the strategy
    makes of it. A document of more than 50,000 chunks is an error; an unknown span is (-1, -1) and has no regions."""
    positioned = layout.position_blocks(blocks)
    if strategy in ("structural", "hierarchical"):
        located = positioned.select("doc_id", F.lit(0).alias("segment"), F.col("ord").alias("part"), "span_start", "span_end", "text")
    else:
        segments = segmentize(positioned)
        located = table_chunks(segments).unionByName(prose_chunks(segments, strategy, size, overlap))
    own = Window.partitionBy("doc_id")
    numbered = located.withColumn("_n", F.count("*").over(own)).withColumn("ord", F.row_number().over(own.orderBy("segment", "part")) - 1)
    many = F.raise_error(F.concat(F.lit("chunking makes "), F.col("_n").cast("string"), F.lit(f" chunks of a document (most {MOST_CHUNKS}); raise the size")))
    checked = numbered.withColumn("ord", F.when(F.col("_n") <= MOST_CHUNKS, F.col("ord")).otherwise(many.cast("int"))).drop("_n", "segment", "part")
    none = F.array().cast(f"array<struct<page:int,bbox:{layout.BOX}>>")
    return sealed(checked).join(regions_of(checked, positioned), ["doc_id", "ord"], "left").withColumn("regions", F.coalesce("regions", none))


def chunk_prompt(passage: str, document: str) -> str:
    """Asks a model to place a passage in its document; the answer goes before the passage when it is embedded."""
    return f"Document:\n{document}\n\nPassage:\n{passage}\n\nSay in one or two sentences where in the document this passage stands and what it is about. Answer with the sentences alone."


def with_context(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """chunks (chunk_id, text) with embedded: the model's sentences (chunk_id, context), if there are any, and the text."""
    return chunks.join(replies.select("chunk_id", "context"), "chunk_id", "left").withColumn("embedded", F.concat_ws("\n\n", F.when(F.trim("context") != "", F.trim("context")), "text")).drop("context")
