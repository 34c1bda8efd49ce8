"""Queries over the library's own operators, with the SQL that checks each. Documents stand for pages and chunks, their
lines for blocks, benchmark passages for queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunking, graph, layout, pages, pixels, retrieval, runs, store
from loomspark.operators.shared import short_batches, spread
from loomspark.sources import html
from loomspark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- inputs


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document, 40 to a page, with a box each; every seventh line is a caption before a table of two."""
    b = layout.text_blocks(_t(spark, sf, "documents"), "\n")
    y = (F.lit(780) - 18 * (F.col("ord") % 40)).cast("double")
    box = F.struct(F.lit(50.0).alias("l"), y.alias("t"), (50 + F.least(F.lit(500), 5 * F.length("text"))).cast("double").alias("r"), (y - 12).alias("b"))
    kind = F.when((F.col("ord") % 7).isin(3, 4), "table").when(F.col("ord") % 7 == 2, "caption").otherwise("text")
    return b.withColumn("page", F.floor(F.col("ord") / 40).cast("int")).withColumn("bbox", box).withColumn("kind", kind).withColumn("self_labeled", F.lit(False))


_LINES = r"""
WITH cut AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents),
blocks AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, ls[i] AS text, CAST((i - 1) // 40 AS INTEGER) AS page,
  CAST(50 + least(500, 5 * length(ls[i])) AS DOUBLE) AS r, CAST(780 - 18 * ((i - 1) % 40) AS DOUBLE) AS t,
  CASE WHEN (i - 1) % 7 IN (3, 4) THEN 'table' WHEN (i - 1) % 7 = 2 THEN 'caption' ELSE 'text' END AS kind
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
placed AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start FROM blocks)
"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", T.stub_embedding(F.col("text")).alias("vector"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", T.stub_embedding(F.col("text")).alias("vector"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "documents")
    return e.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("set_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.col("lang").alias("owner"), (F.col("doc_id") % 5 != 0).alias("enabled"))


_IDX = "WITH idx AS (SELECT 'c' || doc_id AS chunk_id, source AS set_id, 'd' || doc_id AS document_id, lang AS owner, doc_id % 5 <> 0 AS enabled FROM documents)"


# ---------------------------------------------------------------- pages and text

_SIGNALS = r"""
WITH t AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, lang, length(t) AS n, CASE WHEN length(t) = 0 THEN 0 ELSE len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\x{FFFD}]')) / length(t) END AS ctrl,
  CASE WHEN len(regexp_extract_all(t, '\p{L}')) = 0 THEN 1 ELSE len(regexp_extract_all(t, '[A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{370}-\x{3FF}\x{400}-\x{4FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]')) / len(regexp_extract_all(t, '\p{L}')) END AS valid FROM t),
r AS (SELECT *, CASE WHEN n < 200 OR ctrl > 0.002 OR valid < 0.6 OR doc_id % 7 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'mineru' ELSE 'vlm' END ELSE 'fast' END AS route FROM s)
"""


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document is said to have graphics, every seventh to be garbled."""
    d = spread(_t(spark, sf, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", T.page_counts(F.col("text")).alias("c"))
    share = lambda a, b, none: F.coalesce(F.try_divide(F.col(f"c.{a}"), F.col(f"c.{b}")), F.lit(none))
    signals = d.select("doc_id", "lang", F.col("c.size").alias("_n"), share("control", "size", 0.0).alias("ctrl"), share("readable", "letters", 1.0).alias("valid"))
    return signals.withColumn("route", T.route_of(F.col("_n"), F.col("ctrl"), F.col("valid"), F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 7 == 0, 0.01))).drop("_n")


@_query(_SIGNALS + "SELECT doc_id, round(CAST(ctrl AS DOUBLE), 6) AS ctrl, round(CAST(valid AS DOUBLE), 6) AS valid, route FROM r")
def page_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _routes(spark, sf).select("doc_id", F.round("ctrl", 6).alias("ctrl"), F.round("valid", 6).alias("valid"), "route")


@_query(_SIGNALS + "SELECT lang, route, count(*) AS n FROM r GROUP BY ALL")
def route_counts_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return layout.route_counts(_routes(spark, sf), "lang")


@_query(_LINES + "SELECT doc_id, ord, text FROM blocks")
def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.text_blocks(_t(spark, sf, "documents"), "\n")


@_query("SELECT sha256(text) AS checksum, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return store.exact_duplicates(_t(spark, sf, "documents"))


@_query("SELECT doc_id, substr(sha256('chunk|v1|{\"size\":400}|' || list_aggregate(list_sort([coalesce(lang, ''), coalesce(source, '')]), 'string_agg', ',')), 1, 32) AS key FROM documents")
def stage_keys(spark: SparkSession, sf: str) -> DataFrame:
    parents = F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    return _t(spark, sf, "documents").select("doc_id", T.stage_key(F.lit("chunk"), F.lit("v1"), F.lit('{"size":400}'), parents).alias("key"))


@_query("SELECT item_id, substr(sha256('embed|mlx|qwen3|1|' || substr(sha256(text), 1, 32)), 1, 32) AS key, 'vec_' || substr(sha256('m'), 1, 16) AS field FROM benchmark")
def embed_row_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select("item_id", T.embed_row_key(F.lit("mlx"), F.lit("qwen3"), F.lit("1"), F.col("text")).alias("key"), T.vec_field(F.lit("m")).alias("field"))


_HASH = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda s: s <> '')) AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1 = 1 THEN n ELSE -n END) AS votes FROM k, range(0, 64) AS r(i) GROUP BY ALL),
p AS (SELECT doc_id, bit_or(CASE WHEN votes > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS h FROM b GROUP BY doc_id),
prints AS (SELECT d.doc_id, coalesce(p.h, 0::UBIGINT) AS h FROM documents d LEFT JOIN p USING (doc_id) WHERE d.text IS NOT NULL)
"""


@_query(_HASH + "SELECT doc_id, lpad(lower(to_hex(h)), 16, '0') AS h FROM prints")
def simhash_docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex(T.simhash(F.col("text"))), 16, "0")).alias("h"))


@_query(_HASH + ", heads AS (SELECT min(doc_id) AS c, h FROM prints GROUP BY h) SELECT a.c AS a, b.c AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM heads a JOIN heads b ON a.c < b.c AND bit_count(xor(a.h, b.h)) <= 3")
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of classes of documents; near_duplicate_classes tells who is in them."""
    return store.near_pairs(store.print_classes(_t(spark, sf, "documents")))


@_query(_HASH + "SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM prints")
def near_duplicate_classes(spark: SparkSession, sf: str) -> DataFrame:
    return store.print_classes(_t(spark, sf, "documents")).select("doc_id", "class_id")


@_query(r"""
WITH i AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda s: s <> '')) AS ws FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda s: s <> '')) AS ws FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(i.ws, d.ws)) / len(i.ws), 6) AS share FROM i, d WHERE len(i.ws) > 0 AND len(list_intersect(i.ws, d.ws)) >= 0.9 * len(i.ws)""")
def benchmark_containment(spark: SparkSession, sf: str) -> DataFrame:
    return store.containment(_t(spark, sf, "benchmark"), _t(spark, sf, "documents"))


@_query("""
WITH c AS (SELECT row_number() OVER () AS i0, CAST(l_quantity * 5 % 256 AS INTEGER) AS r, CAST(floor(l_extendedprice) % 256 AS INTEGER) AS g, CAST(l_partkey % 256 AS INTEGER) AS b FROM lineitem),
s(i, name, x, y, z) AS (VALUES (0, 'red', 220, 60, 60), (1, 'orange', 235, 150, 70), (2, 'yellow', 240, 235, 120), (3, 'green', 130, 220, 150), (4, 'blue', 150, 160, 235), (5, 'purple', 170, 110, 200), (6, 'pink', 240, 150, 200)),
n AS (SELECT *, row_number() OVER (PARTITION BY i0 ORDER BY (r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z), i) AS k FROM c, s)
SELECT CASE WHEN greatest(r, g, b) - least(r, g, b) >= 28 THEN name END AS color, count(*) AS n FROM n WHERE k = 1 GROUP BY ALL""")
def color_names(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "lineitem").select((F.col("l_quantity") * 5 % 256).cast("int").alias("r"), (F.floor("l_extendedprice") % 256).cast("int").alias("g"), (F.col("l_partkey") % 256).cast("int").alias("b"))
    return c.groupBy(T.color_name(F.col("r"), F.col("g"), F.col("b")).alias("color")).agg(F.count("*").alias("n"))


@_query(r"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(split_part(regexp_replace(text, '^\s+', ''), chr(10), 1), '\s+'), lambda s: s <> '')[1:12], ' ') AS query FROM conversations WHERE text IS NOT NULL""")
def clean_queries(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("<think>a\nb</think>\nStandalone query: "), T.js_trim(F.col("text")))
    return _t(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", T.clean_query(reply, 12).alias("query"))


@_query(r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), '|') AS queries FROM conversations WHERE text IS NOT NULL""")
def query_lists(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat(F.lit("- "), s)), "\n")
    found = T.parse_query_list(F.concat(F.lit("```\n"), listed, F.lit("\n```")), F.lit(""))
    return _t(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(found, "|").alias("queries"))


@_query("""SELECT p_partkey, CASE e WHEN 0 THEN 'sheet' WHEN 1 THEN 'text' WHEN 2 THEN 'image' WHEN 3 THEN 'legacy_sheet' WHEN 4 THEN 'soffice' WHEN 5 THEN 'office' ELSE 'pdf' END AS route,
CASE e WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/vnd.oasis.opendocument.spreadsheet' WHEN 4 THEN 'application/rtf' WHEN 5 THEN 'text/html' ELSE 'application/pdf' END AS mime
FROM (SELECT p_partkey, p_partkey % 7 AS e FROM part)""")
def file_routes(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.lit("."), F.element_at(F.array(*map(F.lit, ("CSV", "md", "png", "ods", "rtf", "html", "pdf"))), (F.col("p_partkey") % 7 + 1).cast("int")))
    return _t(spark, sf, "part").select("p_partkey", T.route_format(name).alias("route"), T.content_type(name).alias("mime"))


# ---------------------------------------------------------------- layout and chunks


@_query(_LINES + "SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS digest, sum(length(text) + 2)::BIGINT - 2 AS size FROM blocks GROUP BY doc_id")
def markdown_of(spark: SparkSession, sf: str) -> DataFrame:
    return layout.markdown_of(_blocks(spark, sf)).select("doc_id", F.md5("markdown").alias("digest"), F.length("markdown").cast("bigint").alias("size"))


@_query(_LINES + "SELECT doc_id, ord, span_start, span_start + length(text) AS span_end FROM placed")
def position_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.position_blocks(_blocks(spark, sf)).select("doc_id", "ord", "span_start", "span_end")


@_query(_LINES + """, h AS (SELECT doc_id, ord, 5.0 + ord % 3 * 10 AS h FROM blocks),
s AS (SELECT *, row_number() OVER w - 1 AS i, h / lag(h) OVER w AS ratio FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY h, ord)),
c AS (SELECT doc_id, i AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ratio DESC, i) AS k FROM s WHERE ratio > 1.8) WHERE k = 1),
n AS (SELECT doc_id, coalesce(any_value(cut), count(*)) // 4 AS at FROM s LEFT JOIN c USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(h AS DOUBLE) AS line_height FROM s JOIN n USING (doc_id) WHERE i = n.at""".replace(" AS at ", " AS mid ").replace("n.at", "n.mid"))
def line_heights(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf).withColumn("bbox", F.struct(F.lit(0.0).alias("l"), (5.0 + F.col("ord") % 3 * 10).alias("t"), F.lit(9.0).alias("r"), F.lit(0.0).alias("b")))
    return layout.line_height(b)


_SPANS = _LINES + """, total AS (SELECT doc_id, max(span_start + length(text)) AS n FROM placed GROUP BY doc_id),
spans AS (SELECT doc_id, j AS part, j * 500 AS s, least(j * 500 + 600, n) AS e FROM total, LATERAL (SELECT unnest(range(0, (n + 499) // 500)) AS j))
, met AS (SELECT spans.doc_id, part, ord, page, r, t, greatest(s, span_start) AS overlap_start, least(e, span_start + length(text)) AS overlap_end
  FROM spans JOIN placed ON spans.doc_id = placed.doc_id AND span_start < e AND span_start + length(text) > s)"""


def _spans(positioned: DataFrame) -> DataFrame:
    """Windows of 600 characters, 500 apart."""
    n = positioned.groupBy("doc_id").agg(F.max("span_end").alias("n"))
    return n.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") + 499) / 500) - 1)).alias("part")).select(F.struct("doc_id", "part").alias("span_id"), "doc_id", (F.col("part") * 500).alias("start"), F.least(F.col("part") * 500 + 600, "n").alias("end"))


@_query(_SPANS + "SELECT doc_id, part, ord, overlap_start, overlap_end FROM met")
def span_regions(spark: SparkSession, sf: str) -> DataFrame:
    p = layout.position_blocks(_blocks(spark, sf))
    return layout.span_regions(_spans(p), p).select("doc_id", F.col("span_id.part").alias("part"), "ord", "overlap_start", "overlap_end")


@_query(_SPANS + """, lined AS (SELECT *, t - 6 AS c, row_number() OVER w AS rn, CASE WHEN t - 6 - lag(t - 6) OVER w > 48 THEN 1 ELSE 0 END AS fresh FROM met WINDOW w AS (PARTITION BY doc_id, part, page ORDER BY t, ord)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, part, page ORDER BY t, ord) AS k FROM lined),
boxes AS (SELECT doc_id, part, page, k, count(*) AS n, max(r) AS r, max(t) AS t, min(t) - 12 AS b FROM g GROUP BY ALL)
SELECT doc_id, part, page, n AS boxes, r, t, b FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, part, page) AS m FROM boxes) WHERE n >= 2 OR n = m""")
def merged_regions(spark: SparkSession, sf: str) -> DataFrame:
    p = layout.position_blocks(_blocks(spark, sf))
    met = layout.span_regions(_spans(p), p).join(p.select("doc_id", "ord", "page", "bbox"), ["doc_id", "ord"])
    return layout.merge_regions(met).select("span_id.doc_id", "span_id.part", "page", "boxes", "r", "t", "b")


@_query(_SPANS.replace("SELECT spans.doc_id, part, ord, page, r, t,", "SELECT spans.doc_id, part, ord, page, r, t, span_start, length(text) AS n,") + """, f AS (SELECT *, (overlap_start - span_start) / greatest(n, 1) AS f0, (overlap_end - span_start) / greatest(n, 1) AS f1, r - 50 AS room FROM met),
x AS (SELECT *, 50 + f0 * room AS x0, 50 + f1 * room AS x1 FROM f), w AS (SELECT *, (f0 <= 0.02 AND f1 >= 0.98) OR room <= 6 OR x1 - x0 < 6 OR x1 - x0 < 0.05 * room AS whole FROM x)
SELECT doc_id, part, ord, page, round(CASE WHEN whole THEN 50.0 ELSE x0 END, 4) AS l, round(CASE WHEN whole THEN r ELSE x1 END, 4) AS r FROM w""")
def clipped_regions(spark: SparkSession, sf: str) -> DataFrame:
    p = layout.position_blocks(_blocks(spark, sf))
    return layout.clip_regions(layout.span_regions(_spans(p), p), p, layout.line_height(p)).select("span_id.*", "ord", "page", F.round("bbox.l", 4).alias("l"), F.round("bbox.r", 4).alias("r"))


@_query(_LINES + """, o AS (SELECT *, lag(text) OVER w AS before FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT *, sum(CASE WHEN text = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM o),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) AS i FROM g)
SELECT doc_id, ord FROM k WHERE n < 3 OR i = 1""")
def collapse_loops(spark: SparkSession, sf: str) -> DataFrame:
    still = F.struct(*[F.lit(0.0).alias(c) for c in "ltrb"])
    return layout.collapse_loops(_blocks(spark, sf).withColumn("bbox", still)).select("doc_id", "ord")


_SITE = _LINES + ", site AS (SELECT d.source AS doc_id, b.doc_id AS page, b.ord, b.text FROM blocks b JOIN documents d USING (doc_id))"


@_query(_SITE + """, pages AS (SELECT doc_id, count(DISTINCT page) AS n FROM site GROUP BY doc_id),
often AS (SELECT doc_id, text, count(DISTINCT page) AS k FROM site GROUP BY ALL)
SELECT s.doc_id AS source, count(*) AS lines FROM site s JOIN pages p USING (doc_id) JOIN often o ON o.doc_id = s.doc_id AND o.text = s.text WHERE NOT (n >= 3 AND k >= greatest(3, ceil(n / 2))) GROUP BY 1""")
def lines_without_furniture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of a source as the pages of one document; lines are compared by text alone."""
    still = F.struct(*[F.lit(0.0).alias(c) for c in "ltrb"])
    site = _blocks(spark, sf).join(_t(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", "source"), "doc_id").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "ord", "text", still.alias("bbox"))
    return layout.drop_furniture(site).groupBy(F.col("doc_id").alias("source")).agg(F.count("*").alias("lines"))


@_query(_LINES + ", p AS (SELECT doc_id, count(*) AS n, count(DISTINCT text) AS d FROM blocks GROUP BY doc_id) SELECT doc_id, n >= 12 AND d / n < 0.6 AS degenerate FROM p")
def degenerate_ocr(spark: SparkSession, sf: str) -> DataFrame:
    return layout.is_degenerate_ocr(_blocks(spark, sf))


@_query("SELECT p_brand AS grid_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS row, p_name || ' │ Part · Size: ' || p_size || ' │ Part · Price: ' || p_type || CASE WHEN p_size > 40 THEN ' [red]' ELSE '' END AS line FROM part")
def grid_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of each brand as a grid below two header rows, of which the first spans two columns."""
    row = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1
    cell = lambda c, v, color=None: F.struct(F.lit(c).alias("col"), v.alias("text"), (color if color is not None else F.lit(None).cast("string")).alias("color"))
    parts = _t(spark, sf, "part").withColumn("row", row.cast("int")).select(F.col("p_brand").alias("grid_id"), "row", F.lit(False).alias("header"), F.explode(F.array(cell(0, F.col("p_name")), cell(1, F.col("p_size").cast("string")), cell(2, F.col("p_type"), F.when(F.col("p_size") > 40, "red")))).alias("c"))
    heads = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in ((0, 0, "Name"), (0, 1, "Part"), (1, 1, "Size"), (1, 2, "Price"))])
    top = _t(spark, sf, "part").select(F.col("p_brand").alias("grid_id")).distinct().select("grid_id", F.explode(heads).alias("h")).select("grid_id", "h.row", F.lit(True).alias("header"), F.struct("h.col", "h.text", F.lit(None).cast("string").alias("color")).alias("c"))
    cells = parts.unionByName(top).select("grid_id", "row", "header", "c.*")
    return layout.describe_grid(cells).select("grid_id", (F.col("row") - 1).cast("int").alias("row"), "line")


_SEGMENTS = _LINES + """, k AS (SELECT *, span_start + length(text) AS span_end, kind = 'table' AS is_table, lead(kind) OVER w AS nx, lag(kind) OVER w AS pv, lag(text) OVER w AS pt FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
u AS (SELECT *, CASE WHEN is_table AND pv = 'caption' THEN pt END AS caption FROM k WHERE NOT (kind = 'caption' AND coalesce(nx, '') = 'table')),
f AS (SELECT *, CASE WHEN lag(is_table) OVER w IS NULL OR is_table <> lag(is_table) OVER w OR caption IS NOT NULL THEN 1 ELSE 0 END AS fresh FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
seg AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY ord) AS INTEGER) AS segment FROM f)"""


@_query(_SEGMENTS + "SELECT doc_id, ord, is_table, caption IS NOT NULL AS captioned, segment FROM seg")
def segmentize(spark: SparkSession, sf: str) -> DataFrame:
    s = chunking.segmentize(layout.position_blocks(_blocks(spark, sf)))
    return s.select("doc_id", "ord", "is_table", F.col("caption").isNotNull().alias("captioned"), "segment")


@_query(_SEGMENTS + """, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY ord) - 1 AS part, first_value(text) OVER (PARTITION BY doc_id, segment ORDER BY ord) AS head, max(caption) OVER (PARTITION BY doc_id, segment) AS cap FROM seg WHERE is_table),
c AS (SELECT doc_id, segment, 0 AS part, min(span_start) AS span_start, max(span_end) AS span_end, concat_ws(chr(10), max(cap), string_agg(text, chr(10) ORDER BY ord)) AS text FROM t GROUP BY doc_id, segment
UNION ALL SELECT doc_id, segment, part, span_start, span_end, concat_ws(chr(10), cap, head, text) FROM t WHERE part > 0)
SELECT doc_id, segment, CAST(part AS INTEGER) AS part, span_start, span_end, sha256(text) AS checksum FROM c""")
def table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.table_chunks(chunking.segmentize(layout.position_blocks(_blocks(spark, sf))))
    return c.select("doc_id", "segment", "part", "span_start", "span_end", F.sha2("text", 256).alias("checksum"))


@_query(_LINES + "SELECT doc_id, ord, sha256(text) AS checksum, lpad(lower(to_hex(ord)), 6, '0') AS rank FROM blocks")
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.structural_chunks(layout.position_blocks(_blocks(spark, sf))).select("doc_id", "ord", "checksum", "rank")


_ALL_CHUNKS = _SEGMENTS + """, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY ord) - 1 AS part, first_value(text) OVER (PARTITION BY doc_id, segment ORDER BY ord) AS head, max(caption) OVER (PARTITION BY doc_id, segment) AS cap FROM seg WHERE is_table),
al AS (SELECT doc_id, segment, 0 AS part, min(span_start) AS a, max(span_end) AS b, concat_ws(chr(10), max(cap), string_agg(text, chr(10) ORDER BY ord)) AS text FROM t GROUP BY doc_id, segment
UNION ALL SELECT doc_id, segment, part, span_start, span_end, concat_ws(chr(10), cap, head, text) FROM t WHERE part > 0
UNION ALL SELECT doc_id, segment, j, rs + j * 280, rs + least(j * 280 + 400, length(run)), substr(run, j * 280 + 1, 400) FROM (SELECT doc_id, segment, min(span_start) AS rs, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS run FROM seg WHERE NOT is_table GROUP BY doc_id, segment), LATERAL (SELECT unnest(range(0, greatest(0, length(run) - 121) // 280 + 1)) AS j)),
nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment, part) - 1 AS ord FROM al)"""


@_query(_ALL_CHUNKS + """, met AS (SELECT nu.doc_id, nu.ord, count(*) AS regions FROM nu JOIN placed p ON p.doc_id = nu.doc_id AND p.span_start < b AND p.span_start + length(p.text) > a GROUP BY ALL)
SELECT nu.doc_id, CAST(nu.ord AS INTEGER) AS ord, lpad(lower(to_hex(nu.ord)), 6, '0') AS rank, CAST(a AS BIGINT) AS span_start, CAST(b AS BIGINT) AS span_end, sha256(text) AS checksum, CAST(coalesce(regions, 0) AS INTEGER) AS regions FROM nu LEFT JOIN met ON met.doc_id = nu.doc_id AND met.ord = nu.ord""")
def built_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of the documents: tables with their captions, prose by character windows, with rank, checksum, regions."""
    c = chunking.build_chunks(_blocks(spark, sf), "character", 400, 120)
    return c.select("doc_id", "ord", "rank", "span_start", "span_end", "checksum", F.size("regions").alias("regions"))


@_query(_SEGMENTS + ", r AS (SELECT doc_id, segment, min(span_start) AS run_start, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS run FROM seg WHERE NOT is_table GROUP BY ALL) SELECT doc_id, segment, run_start, md5(run) AS digest FROM r")
def prose_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs_ = chunking.prose_runs(chunking.segmentize(layout.position_blocks(_blocks(spark, sf))))
    return runs_.select("doc_id", "segment", "run_start", F.md5("text").alias("digest"))


@_query(_LINES + ", p AS (SELECT *, span_start + length(text) AS e FROM placed), m AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS md FROM blocks GROUP BY doc_id) SELECT doc_id, ord, sha256(substr(md, span_start + 1, e - span_start)) AS checksum, CAST(CASE WHEN ord % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS regions FROM p JOIN m USING (doc_id)")
def remapped_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The spans of the blocks without their text, every fifth of them lost."""
    p = layout.position_blocks(_blocks(spark, sf))
    lost = lambda c: F.when(F.col("ord") % 5 == 0, F.lit(-1)).otherwise(F.col(c)).alias(c)
    spans = p.select("doc_id", "ord", lost("span_start"), lost("span_end"), F.when(F.col("ord") % 5 == 0, F.col("text")).alias("text"))
    return chunking.remap_span(spans, layout.markdown_of(p), p).select("doc_id", "ord", "checksum", F.size("regions").alias("regions"))


@_query(_LINES + ", s AS (SELECT doc_id, page, count(*) AS n FROM blocks GROUP BY ALL) SELECT doc_id, page, n = 1 AND doc_id % 2 = 0 AS geometryless FROM s")
def geometryless_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of even id are taken to have no boxes."""
    b = _blocks(spark, sf)
    return layout.is_geometryless(b.withColumn("bbox", F.when(F.col("doc_id") % 2 != 0, F.col("bbox"))))


@_query(_LINES + "SELECT doc_id, CASE WHEN max(CAST(kind = 'table' AND doc_id % 3 = 0 AS INTEGER)) = 1 THEN 'grid' WHEN doc_id % 2 = 0 THEN 'spatial' ELSE 'none' END AS geometry FROM blocks GROUP BY doc_id")
def geometries(spark: SparkSession, sf: str) -> DataFrame:
    """Table lines of every third document have cells, documents of even id have boxes."""
    b = _blocks(spark, sf)
    return layout.geometry_of(b.withColumn("cell", F.when((F.col("kind") == "table") & (F.col("doc_id") % 3 == 0), F.col("ord"))).withColumn("bbox", F.when(F.col("doc_id") % 2 == 0, F.col("bbox"))))


@_query(_LINES + ", k AS (SELECT doc_id, ord % 50 AS o, kind, text, page, min(ord) AS ord FROM blocks GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind = 'table', ord) - 1 AS INTEGER) AS ord, kind, md5(text) AS digest FROM (SELECT doc_id, kind, text, page, min(ord) AS ord FROM blocks GROUP BY ALL)")
def flattened_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Equal lines of a page once, tables last."""
    nodes = _blocks(spark, sf).select("doc_id", "ord", "kind", "text", "page", F.struct(*[F.lit(0.0).alias(c) for c in "ltrb"]).alias("bbox"))
    return pages.flatten(nodes).select("doc_id", "ord", "kind", F.md5("text").alias("digest"))


@_query("""SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(x AS DOUBLE) AS l, CAST(CASE WHEN flip THEN 800 - t ELSE t END AS DOUBLE) AS t, CAST(CASE WHEN flip THEN 800 - b ELSE b END AS DOUBLE) AS b
FROM (SELECT s_suppkey, s_suppkey % 90 AS x, s_suppkey % 50 * 10 AS t, s_suppkey % 70 * 10 AS b, (s_suppkey % 50 < s_suppkey % 70 OR s_suppkey % 4 = 0) AND s_suppkey % 5 <> 0 AS flip FROM supplier)""")
def bottom_left_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes whose y grows downward by itself or by their origin; every fifth page has no known height."""
    k = F.col("s_suppkey")
    box = F.struct((k % 90).cast("double").alias("l"), (k % 50 * 10).cast("double").alias("t"), (k % 90 + 5).cast("double").alias("r"), (k % 70 * 10).cast("double").alias("b"))
    turned = layout.to_bottom_left(box, F.when(k % 5 != 0, F.lit(800.0)), F.when(k % 4 == 0, "TOPLEFT").otherwise("BOTTOMLEFT"))
    return _t(spark, sf, "supplier").select(k.cast("bigint").alias("id"), turned["l"].alias("l"), turned["t"].alias("t"), turned["b"].alias("b"))


@_query("SELECT p_partkey AS id, CASE WHEN length(trim(left(p_name, p_size % 6))) <= 3 AND p_size % 2 = 0 THEN 'legend' WHEN p_size % 3 = 0 THEN NULL ELSE 'red' END AS color FROM part")
def cell_colors(spark: SparkSession, sf: str) -> DataFrame:
    """Legend entries count for cells of hardly any text."""
    size = F.col("p_size")
    color = pages.cell_color(F.substring("p_name", F.lit(1), (size % 6).cast("int")), F.when(size % 2 == 0, "legend"), F.when(size % 3 != 0, "red"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), color.alias("color"))


@_query("""SELECT doc_id, ord, CASE WHEN route = 'fast' OR (route = 'mineru' AND NOT m AND NOT v) OR (route = 'vlm' AND NOT v) THEN CASE WHEN route = 'fast' THEN 'fast' ELSE 'rejected' END WHEN route = 'mineru' AND m THEN 'mineru' ELSE 'vlm' END AS engine
FROM (SELECT o_orderkey AS doc_id, 0 AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'mineru' WHEN 1 THEN 'vlm' ELSE 'fast' END AS route, o_custkey % 2 = 0 AS m, o_custkey % 3 = 0 AS v FROM orders)""")
def routed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages of one block; some have no route, and not every page is parsed by every engine."""
    page = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("ord"), "o_custkey")
    route = F.when(F.col("doc_id") % 4 == 0, "mineru").when(F.col("doc_id") % 4 == 1, "vlm").when(F.col("doc_id") % 4 == 2, "fast")
    routes = page.select("doc_id", "page", route.alias("route")).where("route IS NOT NULL")
    return pages.routed_blocks(page, routes, page.where("o_custkey % 2 = 0"), page.where("o_custkey % 3 = 0")).select("doc_id", "ord", "engine")


@_query("""SELECT doc_id, CAST(j AS INTEGER) AS ord, CAST(j * 280 AS BIGINT) AS span_start, CAST(least(j * 280 + 400, length(text)) AS BIGINT) AS span_end, substr(text, CAST(j * 280 + 1 AS BIGINT), 400) AS text
FROM documents, LATERAL (SELECT unnest(range(0, greatest(0, length(text) - 121) // 280 + 1)) AS j) WHERE length(text) > 0""")
def character_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.character_windows(_t(spark, sf, "documents"))


@_query()
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_texts(_t(spark, sf, "documents"), "recursive")


@_query()
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_texts(_t(spark, sf, "documents"), "sentence")


@_query()
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return html.html_blocks(_t(spark, sf, "pages"))


# ---------------------------------------------------------------- retrieval

_BM25 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda s: s <> '') AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
sc AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 20)
"""


@_query(_BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieval.bm25_topk(_chunks(spark, sf), _asked(spark, sf), 20), "score")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six places for comparing results; the operators rank by more."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@_query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) AS r(i) GROUP BY ALL),
c AS (SELECT label AS query_id, list(m ORDER BY i) AS m FROM x GROUP BY label),
s AS (SELECT query_id, vec_id AS chunk_id, round((1 + list_cosine_similarity(e, m)) / 2, 9) AS score FROM v, c)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def knn_of_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to the mean of each label."""
    v = _t(spark, sf, "embeddings")
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    asked = mean.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("vector"))
    return _rounded(retrieval.knn_topk(v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), asked, 10), "score")


_LEGS = (
    _BM25
    + """, sv AS (SELECT doc_id AS chunk_id, list_transform(range(0, 8), lambda i: ((length(text) + i) % 7) / 7.0::DOUBLE) AS v FROM documents),
qv AS (SELECT item_id AS query_id, list_transform(range(0, 8), lambda i: ((length(text) + i) % 7) / 7.0::DOUBLE) AS v FROM benchmark),
vs AS (SELECT query_id, chunk_id, round((1 + list_cosine_similarity(sv.v, qv.v)) / 2, 9) AS score FROM sv, qv),
ve AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 20),
u AS (SELECT coalesce(ve.query_id, kw.query_id) AS query_id, coalesce(ve.chunk_id, kw.chunk_id) AS chunk_id, ve.score AS vs, ve.rank AS vr, kw.score AS ks, kw.rank AS kr FROM ve FULL JOIN kw ON ve.query_id = kw.query_id AND ve.chunk_id = kw.chunk_id),
mm AS (SELECT *, min(coalesce(vs, 0)) OVER q AS vl, max(coalesce(vs, 0)) OVER q AS vh, min(coalesce(ks, 0)) OVER q AS kl, max(coalesce(ks, 0)) OVER q AS kh FROM u WINDOW q AS (PARTITION BY query_id)),
nn AS (SELECT *, CASE WHEN vh = vl THEN 1.0 ELSE (coalesce(vs, 0) - vl) / (vh - vl) END * 1.4 AS a, CASE WHEN kh = kl THEN 1.0 ELSE (coalesce(ks, 0) - kl) / (kh - kl) END * 0.6 AS b FROM mm)
"""
)
_FUSED = ", fz AS (SELECT *, round(CAST({how} AS DOUBLE), 9) AS fused FROM nn) SELECT query_id, chunk_id, round(vs, 6) AS vector_score, vr AS vector_rank, round(ks, 6) AS bm25_score, kr AS bm25_rank, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fz.fused DESC, vr NULLS LAST, kr NULLS LAST, chunk_id) AS INTEGER) AS fused_rank FROM fz"
_HOW = {
    "arithmetic_mean": "(a + b) / 2",
    "geometric_mean": "sqrt(greatest(a * b, 0))",
    "harmonic_mean": "CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END",
    "reciprocal_rank_fusion": "0.7 / (60 + coalesce(vr, 40)) + 0.3 / (60 + coalesce(kr, 40))",
}


def _fusion(technique: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        chunks, asked = _chunks(spark, sf), _asked(spark, sf)
        return _rounded(retrieval.fuse(retrieval.knn_topk(chunks, asked), retrieval.bm25_topk(chunks, asked), technique), "vector_score", "bm25_score", "fused")

    return run


for _technique, _how in _HOW.items():
    QUERIES[f"fuse_{_technique}"] = _fusion(_technique)
    ORACLE[f"fuse_{_technique}"] = _LEGS + _FUSED.format(how=_how)


@_query(_LEGS + _FUSED.format(how="(a + b) / 2").replace("AS fused_rank FROM fz", "AS final_rank FROM fz"))
def retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    found = _rounded(retrieval.retrieve(_chunks(spark, sf), _asked(spark, sf), near_duplicates=False), "vector_score", "bm25_score", "fused")
    return found.select("query_id", "chunk_id", "vector_score", "vector_rank", "bm25_score", "bm25_rank", "fused", "final_rank")


_GREEDY = (
    "WITH RECURSIVE" + _LEGS.lstrip().removeprefix("WITH") + ", " + _HASH.lstrip().removeprefix("WITH").replace("p AS (SELECT doc_id, bit_or", "hp AS (SELECT doc_id, bit_or").replace("LEFT JOIN p ", "LEFT JOIN hp ").replace("p.h", "hp.h") + """,
fz AS (SELECT *, round(CAST((a + b) / 2 AS DOUBLE), 9) AS fused FROM nn),
rk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vr NULLS LAST, kr NULLS LAST, chunk_id) AS k, h, coalesce(text, '') <> '' AS full_ FROM fz JOIN documents d ON d.doc_id = chunk_id LEFT JOIN prints p ON p.doc_id = chunk_id),
go AS (SELECT query_id, 0::BIGINT AS k, []::UBIGINT[] AS kept, NULL::BIGINT AS chunk_id, false AS stays FROM (SELECT DISTINCT query_id FROM rk)
UNION ALL SELECT g.query_id, r.k, CASE WHEN r.full_ AND len(list_filter(g.kept, lambda x: bit_count(xor(x, r.h)) <= 3)) = 0 THEN list_append(g.kept, r.h) ELSE g.kept END, r.chunk_id, NOT r.full_ OR len(list_filter(g.kept, lambda x: bit_count(xor(x, r.h)) <= 3)) = 0
FROM go g JOIN rk r ON r.query_id = g.query_id AND r.k = g.k + 1)
"""
)


@_query(_GREEDY + "SELECT query_id, chunk_id, CAST(k AS INTEGER) AS fused_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS final_rank FROM go WHERE stays")
def retrieve_without_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.retrieve(_chunks(spark, sf), _asked(spark, sf)).select("query_id", "chunk_id", "fused_rank", "final_rank")


@_query(_LEGS + """, fz AS (SELECT *, round(CAST((a + b) / 2 AS DOUBLE), 9) AS fused FROM nn), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vr NULLS LAST, kr NULLS LAST, chunk_id) AS k FROM fz)
SELECT query_id, chunk_id, 'd' || chunk_id AS document_id, '' AS document_name, CAST(length(text) % 7 AS DOUBLE) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(text) % 7 DESC NULLS LAST, k) AS INTEGER) AS final_rank, false AS assembled FROM fr JOIN documents ON doc_id = chunk_id""")
def reranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every column a candidate has besides its legs, ranked by a stand-in for a reranking model."""
    chunks = _chunks(spark, sf).withColumn("document_id", F.concat(F.lit("d"), F.col("chunk_id").cast("string")))
    asked = _asked(spark, sf).drop("vector")
    found = retrieval.retrieve(chunks, asked, near_duplicates=False, embed=T.stub_embedding, reranker=(F.length("chunk_text") % 7).cast("double"))
    return found.select("query_id", "chunk_id", "document_id", "document_name", "rerank_score", "final_rank", "assembled")


@_query(_LEGS + """, ks AS (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi FROM kw WINDOW q AS (PARTITION BY query_id)), vz AS (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi FROM ve WINDOW q AS (PARTITION BY query_id)),
l AS (SELECT query_id, chunk_id, 0.3 AS w, greatest(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 0.001) AS x FROM ks UNION ALL SELECT query_id, chunk_id, 0.7, greatest(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 0.001) FROM vz)
SELECT query_id, chunk_id, round(round(sum(CAST(w AS DOUBLE) * x), 9), 6) AS score FROM l GROUP BY ALL""")
def store_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    chunks, asked = _chunks(spark, sf), _asked(spark, sf)
    return _rounded(retrieval.hybrid_scores(retrieval.bm25_topk(chunks, asked), retrieval.knn_topk(chunks, asked), (0.3, 0.7)), "score").select("query_id", "chunk_id", "score")


@_query(_BM25 + "SELECT b.item_id AS query_id, w.chunk_id, round(kw.score, 6) AS score, kw.rank FROM benchmark b JOIN (SELECT min(doc_id) AS chunk_id FROM documents UNION ALL SELECT max(doc_id) FROM documents) w ON true LEFT JOIN kw ON kw.query_id = b.item_id AND kw.chunk_id = w.chunk_id")
def bm25_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The place of the first and of the last document among the hits of each query, null where it isn't one."""
    ends = _t(spark, sf, "documents").agg(F.array(F.min("doc_id"), F.max("doc_id")).alias("e")).select(F.explode("e").alias("chunk_id"))
    return retrieval.bm25_rank(bm25_topk(spark, sf), _asked(spark, sf).select("query_id").crossJoin(F.broadcast(ends)))


@_query(_BM25 + ", h AS (SELECT query_id, chunk_id % 40 AS chunk_id, CASE WHEN rank % 5 <> 0 THEN score END AS score, rank FROM kw), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) AS k FROM h) SELECT query_id, chunk_id, round(coalesce(score, 0), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM f WHERE k = 1")
def deduped_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits whose ids repeat, some without a score."""
    hits = bm25_topk(spark, sf).select("query_id", (F.col("chunk_id") % 40).alias("chunk_id"), F.when(F.col("rank") % 5 != 0, F.col("score")).alias("score"), "rank")
    return retrieval.dedupe_hits(hits)


_MIDDLE = "CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE count(*) OVER (PARTITION BY query_id) - 1 - (rank - 2) // 2 END"


@_query(_BM25 + f"SELECT query_id, chunk_id, CAST({_MIDDLE} AS INTEGER) AS position FROM kw")
def lost_in_the_middle(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.lost_in_the_middle(bm25_topk(spark, sf), "query_id", "rank").select("query_id", "chunk_id", "position")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_topk(spark, sf).join(_chunks(spark, sf), "chunk_id")


@_query("WITH RECURSIVE" + _BM25.lstrip().removeprefix("WITH") + """,
it AS MATERIALIZED (SELECT query_id, chunk_id, rank, round(score, 6) AS score, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS ws FROM kw JOIN documents ON doc_id = chunk_id),
ls AS MATERIALIZED (SELECT query_id, list(chunk_id ORDER BY rank) AS ids, list(score ORDER BY rank) AS sc, count(*) AS n FROM it GROUP BY query_id),
pj AS (SELECT a.query_id, a.rank AS i, b.rank AS j, CASE WHEN len(a.ws) = 0 AND len(b.ws) = 0 THEN 1.0 ELSE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) END::DOUBLE AS s FROM it a JOIN it b USING (query_id)),
mm AS MATERIALIZED (SELECT query_id, list(rw ORDER BY i) AS m FROM (SELECT query_id, i, list(s ORDER BY j) AS rw FROM pj GROUP BY ALL) GROUP BY query_id),
go AS (SELECT query_id, 0 AS k, []::BIGINT[] AS picked, list_transform(range(0, n), lambda x: 0.0::DOUBLE) AS worst, NULL::BIGINT AS best FROM ls
UNION ALL SELECT query_id, k + 1, list_append(picked, b), list_transform(range(1, n + 1), lambda i: greatest(worst[i], m[b][i])), b
FROM (SELECT g.query_id, g.k, g.picked, g.worst, l.n, mm.m, list_transform(range(1, l.n + 1), lambda i: CASE WHEN list_contains(g.picked, i) THEN NULL ELSE 0.5::DOUBLE * l.sc[i] - 0.5::DOUBLE * g.worst[i] END) AS v, CAST(list_position(v, list_max(v)) AS BIGINT) AS b FROM go g JOIN ls l USING (query_id) JOIN mm USING (query_id) WHERE g.k < least(10, l.n)))
SELECT query_id, ids[best] AS chunk_id, CAST(k AS INTEGER) AS mmr_rank FROM go JOIN ls USING (query_id) WHERE k > 0""")
def diversified(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.maximal_marginal_relevance(_hits(spark, sf).select("query_id", "chunk_id", F.col("rank").alias("ord"), "score", "text")).select("query_id", "chunk_id", "mmr_rank")


@_query(_BM25 + """, c AS (SELECT query_id, chunk_id, chunk_id % 50 AS parent_id, score FROM kw), g AS (SELECT *, count(*) OVER (PARTITION BY query_id, parent_id) / 4 >= 0.5 AS m FROM c)
SELECT query_id, chunk_id, round(score, 6) AS score, 0 AS merged FROM g WHERE NOT m UNION ALL SELECT query_id, parent_id, round(max(score), 6), CAST(count(*) AS INTEGER) FROM g WHERE m GROUP BY query_id, parent_id""")
def auto_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Parents of the documents of equal remainder, each said to have four children."""
    children = _hits(spark, sf).select("query_id", "chunk_id", (F.col("chunk_id") % 50).alias("parent_id"), "score", "text", F.col("rank").alias("ord"))
    parents = _t(spark, sf, "documents").select((F.col("doc_id") % 50).alias("chunk_id")).distinct().select("chunk_id", F.lit(4).alias("child_count"), F.lit("p").alias("text"))
    return retrieval.auto_merge(children, parents).select("query_id", "chunk_id", "score", "merged")


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> ''))"


@_query(_BM25 + f", s AS (SELECT query_id, chunk_id, rank, {_WORDS} AS cost FROM kw JOIN documents ON doc_id = chunk_id), c AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM s) SELECT query_id, CAST(sum(cost) AS BIGINT) AS context_tokens, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS included FROM c WHERE rank = 1 OR total <= 2000 GROUP BY query_id")
def assemble_context(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.assemble_context(_hits(spark, sf).select("query_id", F.col("rank").alias("ord"), "chunk_id", "text"), 2000).select("query_id", "context_tokens", "included")


@_query(_BM25 + f""", h AS (SELECT query_id, chunk_id, (rank - 1) % 3 AS hop, rank // 3 AS idx, rank FROM kw), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idx, hop) AS o FROM h),
s AS (SELECT query_id, chunk_id, o, {_WORDS} AS cost FROM r JOIN documents ON doc_id = chunk_id), c AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY o) AS total FROM s)
SELECT query_id, CAST(sum(cost) AS BIGINT) AS context_tokens, string_agg(chunk_id::VARCHAR, ',' ORDER BY o) AS included FROM c WHERE o = 1 OR total <= 2000 GROUP BY query_id""")
def assemble_hops(spark: SparkSession, sf: str) -> DataFrame:
    hops = _hits(spark, sf).select("query_id", ((F.col("rank") - 1) % 3).alias("hop"), F.floor(F.col("rank") / 3).alias("idx"), "chunk_id", "text")
    return retrieval.assemble_hops(hops, 2000).select("query_id", "context_tokens", "included")


@_query(_BM25 + "SELECT item_id AS query_id, CAST(min(rank) AS INTEGER) AS gold_rank FROM benchmark b LEFT JOIN (SELECT kw.*, text AS passage FROM kw JOIN documents ON doc_id = chunk_id) h ON h.query_id = b.item_id AND contains(passage, b.text) GROUP BY item_id")
def gold_rank(spark: SparkSession, sf: str) -> DataFrame:
    gold = _asked(spark, sf).select("query_id", F.col("text").alias("gold"))
    return runs.gold_rank(_hits(spark, sf).select("query_id", F.col("rank").alias("final_rank"), F.col("text").alias("chunk_text")), gold)


# ---------------------------------------------------------------- index, graph, runs


@_query(_IDX + "SELECT chunk_id, owner FROM idx WHERE enabled AND set_id IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents) AND owner = 'en'")
def scoped_chunks(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    ends = index.agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).first()
    return retrieval.in_scope(index, list(ends), "en").select("chunk_id", "owner")


@_query(_IDX + "SELECT set_id, count(*) AS n FROM idx GROUP BY set_id")
def searchable_count(spark: SparkSession, sf: str) -> DataFrame:
    return store.searchable_count(_index(spark, sf))


@_query(_IDX + "SELECT chunk_id, set_id, document_id, CASE WHEN chunk_id[2:]::BIGINT % 3 = 0 THEN 'new' ELSE owner END AS owner FROM idx WHERE chunk_id[2:]::BIGINT % 3 <> 1")
def index_upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the index written anew, another third deleted."""
    index = _index(spark, sf)
    number = F.substring("chunk_id", 2, 20).cast("bigint")
    fresh = index.where(number % 3 == 0).withColumn("owner", F.lit("new"))
    return store.delete_ids(store.upsert(index, fresh), index.where(number % 3 == 1)).select("chunk_id", "set_id", "document_id", "owner")


@_query(_IDX + "SELECT chunk_id, set_id, document_id, owner FROM idx UNION ALL SELECT chunk_id || 'x', coalesce(set_id, set_id), CASE WHEN document_id[2:]::BIGINT % 2 = 0 THEN document_id || 'y' ELSE document_id END, 'copy' FROM idx WHERE owner = 'en' AND chunk_id[2:]::BIGINT % 3 <> 0")
def reindex_clone(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    number = lambda c: F.substring(c, 2, 20).cast("bigint")
    chunks = index.where(number("chunk_id") % 3 != 0).select(F.col("chunk_id").alias("old"), F.concat("chunk_id", F.lit("x")).alias("new"))
    documents = index.where(number("document_id") % 2 == 0).select(F.col("document_id").alias("old"), F.concat("document_id", F.lit("y")).alias("new"))
    none = documents.where("false")
    return store.clone(index, "en", "copy", chunks, none, documents).select("chunk_id", "set_id", "document_id", "owner")


@_query(r"""WITH m AS (SELECT o_orderkey AS chunk_id, o_orderpriority AS name, trim(regexp_replace(regexp_replace(lower(o_orderpriority), '[^\p{L}\p{N}\s_]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM orders)
SELECT key, min(name) AS name, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks FROM m WHERE key <> '' GROUP BY key""")
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dedupe_entities(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("name"), F.lit("priority").alias("type")))


_TREES = """WITH k AS (SELECT 'c' || c_custkey AS member, 'n' || c_nationkey AS g FROM customer UNION SELECT 'n' || c_nationkey, 'n' || c_nationkey FROM customer
UNION SELECT 'o' || o_orderkey, coalesce('n' || c_nationkey, 'c' || o_custkey) FROM orders LEFT JOIN customer ON c_custkey = o_custkey UNION SELECT 'c' || o_custkey, 'c' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)),
f AS (SELECT member, min(member) OVER (PARTITION BY g) AS community FROM k)"""


@_query(_TREES + " SELECT member, community FROM f")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with their customers and those customers' orders: a few trees of very uneven size."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = _t(spark, sf, "customer").select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"))
    return graph.communities(edges.unionByName(_t(spark, sf, "orders").select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target"))))


@_query(_TREES + " SELECT community, count(*) AS size, array_to_string(list(member ORDER BY member)[1:24], ', ') AS members FROM f GROUP BY 1")
def community_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.community_sizes(communities(spark, sf))


@_query(_TREES + """, a AS (SELECT max(n) / sum(n) > 0.5 AS d FROM (SELECT count(*) AS n FROM f GROUP BY community)),
b AS (SELECT max(n) / sum(n) > 0.5 AS d FROM (SELECT count(*) + 1 AS n FROM part GROUP BY p_size <= 40))
SELECT 'nations' AS graph, d AS degenerate FROM a UNION ALL SELECT 'sizes', d FROM b UNION ALL SELECT 'none', true""")
def communities_degenerate(spark: SparkSession, sf: str) -> DataFrame:
    """Of the nations' trees, of parts by whether they are small, most of which are, and of a graph without edges."""
    parts = _t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"), F.when(F.col("p_size") <= 40, "small").otherwise("large").alias("target"))
    named = lambda name, edges: graph.is_degenerate(graph.communities(edges)).select(F.lit(name).alias("graph"), "degenerate")
    nations = graph.is_degenerate(communities(spark, sf)).select(F.lit("nations").alias("graph"), "degenerate")
    return nations.unionByName(named("sizes", parts)).unionByName(named("none", parts.where("false")))


@_query("""WITH q AS (SELECT list(avg_ ORDER BY i) AS q FROM (SELECT i, avg(embedding[i]::DOUBLE) AS avg_ FROM embeddings, range(1, 65) AS r(i) WHERE label = 0 GROUP BY i)),
s AS (SELECT vec_id AS name, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q)
SELECT name, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 25""")
def similar_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to the mean of a label, a top-k report."""
    v = _t(spark, sf, "embeddings")
    mean = [r["m"] for r in v.where("label = 0").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()]  # one vector
    return _rounded(graph.rank_by_similarity(v.select(F.col("vec_id").alias("name"), F.col("embedding").alias("vec")), mean, 25, 0.1), "score")


@_query("SELECT s_suppkey AS id, s_name || ' (supplier)' AS entity, s_name || ' — ' || n_name AS relationship, CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name ELSE s_name || ', ' || n_name END AS community FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def graph_texts(spark: SparkSession, sf: str) -> DataFrame:
    both = _t(spark, sf, "supplier").join(F.broadcast(_t(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    summary = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("about "), "s_name"))
    return both.select(F.col("s_suppkey").alias("id"), graph.entity_text(F.col("s_name"), F.lit("supplier")).alias("entity"), graph.relationship_text(F.col("s_name"), F.col("n_name")).alias("relationship"), graph.community_text(summary, F.array("s_name", "n_name")).alias("community"))


@_query("SELECT o_orderkey AS query_id, n_name AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def matched_names(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about an order's nation against the names of all nations."""
    asked = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(_t(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    questions = asked.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("What about  "), "n_name", F.lit(", then?")).alias("text"))
    return graph.match_entity_names(questions, _t(spark, sf, "nation").select(F.col("n_name").alias("name")))


@_query("SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Order ' || o_orderkey END AS entities, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS relationships FROM orders")
def extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of a model about orders: a third broken, the others with names to drop, a repeated and a self-made edge."""
    k = F.col("o_orderkey").cast("string")
    reply = F.concat(F.lit('```json\n{"entities":[{"name":"Order '), k, F.lit('","type":"order"},{"name":"x"},{"name":"15.000"},{"name":"Nowhere"}],"relationships":[{"source":"Order '), k, F.lit('","target":"Priority"},{"source":"Order '), k, F.lit('","target":"Order '), k, F.lit('"}]}\n```'))
    passage = F.concat(F.lit("Order "), k, F.lit(" has a priority."))
    replies = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("{broken")).otherwise(reply).alias("raw"), passage.alias("passage"))
    found = graph.parse_extraction(replies)
    return found.select("chunk_id", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("entities"), (F.size("relationships") + F.when(F.col("chunk_id") % 3 == 0, 0).otherwise(1)).alias("relationships"))


@_query("""WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM h WHERE k <= 6 GROUP BY conv_id""")
def contextualized_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return runs.contextualize(_t(spark, sf, "conversations"))


@_query("SELECT event_type AS model, round(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 100 * 0.5 + event_id % 7 * 2.0 END), 4) AS cost FROM events GROUP BY 1")
def stage_costs(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "events").select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 4 == 0, "free").otherwise("metered").alias("billing_mode"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"))
    prices = m.select("model").distinct().select("model", F.lit(0.5).alias("input_price"), F.lit(2.0).alias("output_price"))
    return runs.cost_of(m, prices).groupBy("model").agg(F.round(F.sum("cost"), 4).alias("cost"))


@_query(_BM25 + "SELECT item_id AS query_id, contains(d.text, b.text) AND NOT (item_id % 2 = 1 AND contains(d.text, left(b.text, 20))) AS grounded FROM kw JOIN benchmark b ON b.item_id = kw.query_id JOIN documents d ON d.doc_id = kw.chunk_id WHERE rank = 1")
def graded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The best hit of each query as the answer; of odd queries the beginning of what is expected is a distractor."""
    gold = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("expect"), F.when(F.col("item_id") % 2 == 1, F.substring("text", 1, 20)).alias("reject"))
    answers = _hits(spark, sf).where("rank = 1").select("query_id", F.col("text").alias("answer")).join(gold, "query_id")
    return runs.grade(answers).select("query_id", "grounded")


@_query("SELECT event_type AS model, round(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 100 * 0.5 END), 4) AS estimate FROM events GROUP BY 1")
def stage_estimates(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "events").select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 4 == 0, "free").otherwise("metered").alias("billing_mode"), (F.col("event_id") % 100).alias("input_tokens"))
    prices = m.select("model").distinct().select("model", F.lit(0.5).alias("input_price"), F.lit(2.0).alias("output_price"))
    return runs.estimate_of(m, prices).groupBy("model").agg(F.round(F.sum("estimate"), 4).alias("estimate"))


@_query("SELECT item_id, 'emb:' || sha256('embed-1 m ' || text) AS emb, 'ctx:' || sha256('ctx-1 m ' || sha256(text) || ' ' || text) AS ctx FROM benchmark")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    text, model = F.col("text"), F.lit("m")
    return _t(spark, sf, "benchmark").select("item_id", store.cache_key("emb", model, text).alias("emb"), store.cache_key("ctx", model, F.sha2(text, 256), text).alias("ctx"))


@_query("SELECT md5(text) AS digest, list_transform(range(0, 8), lambda i: ((length(text) + i) % 7) / 7.0::DOUBLE)[1] AS first_ FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the texts come from the cache, to which they were written before."""
    d = _t(spark, sf, "documents")
    empty = spark.createDataFrame([], "key string, vector array<double>, cached_at timestamp")
    known = store.embed_texts(d.where("length(text) % 2 = 0"), empty, "m", T.stub_embedding)
    found = store.embed_texts(d, store.remember(empty, known), "m", T.stub_embedding)
    return found.select(F.md5("text").alias("digest"), F.get("vector", F.lit(0)).alias("first_"))


@_query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of the streaming ingest, over the whole table."""
    return ingest.event_counts(_t(spark, sf, "events"))


@_query("""WITH l(label, r, g, b) AS (VALUES ('low', 50, 0, 0), ('middle', 120, 20, 0), ('high', 200, 0, 10), ('alike', 50, 0, 0)), c AS (SELECT p_partkey AS id, p_size * 5 AS r, p_partkey % 30 AS g FROM part),
d AS (SELECT id, label, (c.r - l.r) * (c.r - l.r) + (c.g - l.g) * (c.g - l.g) + l.b * l.b AS d FROM c, l), n AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY d, label) AS k FROM d WHERE d <= 3000)
SELECT c.id, n.label FROM c LEFT JOIN n ON n.id = c.id AND k = 1""")
def legend_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Parts coloured by size and key, against a legend in which two entries are alike; some colours are far from all."""
    colors = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 30).alias("g"), F.lit(0).alias("b"))
    legend = spark.createDataFrame([("low", 50, 0, 0), ("middle", 120, 20, 0), ("high", 200, 0, 10), ("alike", 50, 0, 0)], "label string, r int, g int, b int")
    return pixels.nearest_label(colors, legend).select("id", "label")
