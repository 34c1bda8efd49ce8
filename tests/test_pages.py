import pytest
from pyspark.sql import functions as F

from loomspark.operators import pages

BOX = "bbox struct<l:double,t:double,r:double,b:double>"


def test_flatten(spark):
    rows = [(1, 0, "table", "t", 1, None), (1, 1, None, "a", 1, None), (1, 2, "text", "a", 1, None), (1, 3, "text", "b", 1, (0.0, 1.0, 2.0, 3.0))]
    out = pages.flatten(spark.createDataFrame(rows, f"doc_id int, ord int, kind string, text string, page int, {BOX}")).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in out] == [(0, "a"), (1, "b"), (2, "t")]


def test_table_rows(spark):
    rows = [("g", 0, 0, 1, True, "Team", None, (0.0, 30.0, 10.0, 20.0)), ("g", 0, 1, 1, True, "Person", None, (10.0, 30.0, 20.0, 20.0)), ("g", 1, 0, 2, False, "A", None, (0.0, 20.0, 10.0, 0.0)), ("g", 1, 1, 1, False, "Alice", None, (10.0, 20.0, 20.0, 10.0)), ("g", 2, 1, 1, False, "Bob", None, (10.0, 10.0, 20.0, 0.0))]
    out = pages.table_row_blocks(spark.createDataFrame(rows, f"grid_id string, row int, col int, row_span int, header boolean, text string, color string, {BOX}")).orderBy("row").collect()
    assert [(r["text"], r["l"], r["t"], r["b"]) for r in out] == [("A │ Person: Alice", 0.0, 20.0, 10.0), ("Person: Bob", 10.0, 10.0, 0.0)]


def test_replies(spark):
    said = ["<think>x</think>```html\n<p>a</p>\n```<|im_end|>rest", "", None, "<|im_start|>"]
    out = spark.createDataFrame([(s,) for s in said], "s string").select(pages.reply_text(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in out] == ["<p>a</p>", None, None, None]


def test_routed(spark):
    b = "doc_id int, page int, ord int, text string"
    base = spark.createDataFrame([(1, p, 0, f"base{p}") for p in range(4)], b)
    routes = spark.createDataFrame([(1, 0, "fast"), (1, 1, "mineru"), (1, 2, "mineru"), (1, 3, "vlm")], "doc_id int, page int, route string")
    out = pages.routed_blocks(base, routes, spark.createDataFrame([(1, 1, 0, "m")], b), spark.createDataFrame([(1, 2, 0, "v")], b)).orderBy("page").collect()
    assert [(r["text"], r["engine"]) for r in out] == [("base0", "fast"), ("m", "mineru"), ("v", "vlm"), ("base3", "rejected")]


def test_words_and_offsets(spark):
    words = spark.createDataFrame([(1, "p", 1, "b", 50, 0, 100, 10), (1, "p", 0, "a", 0, 0, 40, 20)], "page_id int, group string, ord int, text string, x0 int, y0 int, x1 int, y1 int")
    assert tuple(pages.word_boxes(words, F.lit(200), F.lit(100)).first())[2:] == ("a b", 0, 0, 500, 200)
    moved = pages.offset(spark.createDataFrame([((0.0, 5.0, 1.0, 2.0),), (None,)], BOX), 10.0).collect()
    assert tuple(moved[0]["bbox"]) == (0, 15, 1, 12) and moved[1]["bbox"] is None


def test_colours_and_retries(spark):
    out = spark.range(1).select(pages.with_color(F.lit("x"), F.lit("green"), F.lit(True)).alias("a"), pages.is_swatch(F.lit("Legend:"), F.lit(True), F.lit(True)).alias("b"), pages.is_swatch(F.lit("surge"), F.lit(True), F.lit(True)).alias("c")).first()
    assert tuple(out) == ("x [green]", False, True)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert pages.resilient(flaky, pause=0) == 7
    with pytest.raises(TimeoutError):
        pages.resilient(lambda: (_ for _ in ()).throw(TimeoutError()), pause=0)
