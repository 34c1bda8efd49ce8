"""Operators on small inputs with known results."""

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark import config
from loomspark.functions import text as T
from loomspark.operators import chunking, graph, layout, pixels, retrieval, runs, store
from loomspark.sources import files, html
from loomspark.streaming import ingest

LEG = "query_id int, chunk_id string, score double, rank int"


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_routes(spark):
    page = "The quick brown fox jumps over the lazy dog. " * 6
    route = lambda t, g: _one(spark, T.route_page(F.lit(t), F.lit(g), F.lit(0.0)))
    assert [route(page, False), route("", False), route("", True), route(page + "\0" * 6, False), route(None, False)] == ["fast", "vlm", "mineru", "vlm", "vlm"]


def test_keys_and_hashes(spark):
    assert _one(spark, T.stage_key(F.lit("chunk"), F.lit("v1"), F.lit('{"size":400}'), F.array(F.lit("h2"), F.lit("h1")))) == "25017723ddbb370b71b8a662f302b067"
    assert _one(spark, T.embed_row_key(F.lit("mlx"), F.lit("qwen3"), F.lit("1"), F.lit("xin chào"))) == "15f89a9c76f06663b6e79c73f9688a7a"
    assert _one(spark, T.vec_field(F.lit("m"))) == "vec_62c66a7a5dd70c31"
    assert f"{T.simhash_value('abc') & (2**64 - 1):016x}" == "900150983cd24fb0" and T.simhash_value("") == 0 and T.simhash_value(None) is None
    assert _one(spark, T.stub_embedding(F.lit("seven77"))) == [0, 1 / 7, 2 / 7, 3 / 7, 4 / 7, 5 / 7, 6 / 7, 0]


@settings(max_examples=60, deadline=None)
@given(st.text(), st.text())
def test_simhash_is_symmetric(a, b):
    x, y = T.simhash_value(a), T.simhash_value(b)
    assert -(2**63) <= x < 2**63 and ((x ^ y) & (2**64 - 1)).bit_count() == ((y ^ x) & (2**64 - 1)).bit_count()


def test_cosine(spark):
    pair = lambda a, b: _one(spark, T.cosine(F.lit(a), F.lit(b)))
    assert [pair([1.0, 0.0], [1.0, 0.0]), pair([1.0, 0.0], [0.0, 1.0]), pair([0.0, 0.0], [1.0, 1.0]), pair([1.0], [1.0, 1.0])] == [1, 0, 0, 0]


def test_query_lists(spark):
    parse = lambda s: _one(spark, T.parse_query_list(F.lit(s), F.lit("q")))
    assert parse('```json\n["a", " b "]\n```') == ["a", "b"] and parse("1. a\n2) b\n- c\n* d") == ["a", "b", "c", "d"]
    assert parse("") == ["q"] and parse("[]") == ["q"]
    assert _one(spark, T.clean_query(F.lit("<think>x</think>\nStandalone query: what is the fee"))) == "what is the fee"
    assert _one(spark, T.normalize_name(F.lit("  Green SM,  "))) == "green sm"


def test_color_names(spark):
    name = lambda r, g, b: _one(spark, T.color_name(F.lit(r), F.lit(g), F.lit(b)))
    assert [name(192, 192, 240), name(240, 240, 144), name(144, 240, 192), name(192, 144, 96), name(200, 200, 210)] == ["blue", "yellow", "green", "orange", None]


def _legs(spark, *rows):
    return spark.createDataFrame([(1, c, s, k) for k, (c, s) in enumerate(rows, 1)], LEG)


@pytest.mark.parametrize(
    ("technique", "want"),
    [
        ("arithmetic_mean", {"a": 0.7, "b": 0.388889, "c": 0.377778, "d": 0.133333}),
        ("geometric_mean", {"c": 0.305505, "a": 0, "b": 0, "d": 0}),
        ("harmonic_mean", {"c": 0.247059, "a": 0, "b": 0, "d": 0}),
        ("reciprocal_rank_fusion", {"c": 0.016029, "a": 0.014475, "b": 0.014290, "d": 0.011839}),
    ],
)
def test_fusion(spark, technique, want):
    got = retrieval.fuse(_legs(spark, ("a", 0.9), ("b", 0.5), ("c", 0.1)), _legs(spark, ("c", 9.0), ("d", 4.0)), technique).orderBy("fused_rank").collect()
    assert {r["chunk_id"]: r["fused"] for r in got} == pytest.approx(want, abs=2e-6) and [r["chunk_id"] for r in got] == list(want)


def test_fusion_without_keywords(spark):
    got = retrieval.fuse(_legs(spark, ("a", 0.9), ("b", 0.5), ("c", 0.1)), _legs(spark, ("a", 1.0)).where("false"))
    assert {r["chunk_id"]: r["fused"] for r in got.collect()} == pytest.approx({"a": 1.0, "b": 0.65, "c": 0.3})


def test_near_duplicates_by_rank(spark):
    rows = [(1, 1, "a", "alpha beta gamma"), (1, 2, "b", "alpha beta gamma"), (1, 3, "c", "nothing like it at all"), (1, 4, "d", ""), (1, 5, "e", ""), (2, 1, "b", "alpha beta gamma")]
    df = spark.createDataFrame(rows, "query_id int, fused_rank int, chunk_id string, chunk_text string")
    assert [(r["query_id"], r["chunk_id"], r["final_rank"]) for r in retrieval.drop_near_duplicates(df).orderBy("query_id", "final_rank").collect()] == [(1, "a", 1), (1, "c", 2), (1, "d", 3), (1, "e", 4), (2, "b", 1)]


def test_order_merge_and_assembly(spark):
    items = spark.createDataFrame([(1, i, c) for i, c in enumerate("abcde")], "q int, o int, c string")
    assert "".join(r["c"] for r in retrieval.lost_in_the_middle(items, "q", "o").orderBy("position").collect()) == "acedb"
    kids = spark.createDataFrame([(1, "a", None, 0.2, "t"), (1, "c1", "p1", 0.6, "t"), (1, "c1", "p1", 0.6, "t"), (1, "b", None, 0.95, "t")], "query_id int, chunk_id string, parent_id string, score double, text string")
    parents = spark.createDataFrame([("p1", 2, "whole")], "chunk_id string, child_count int, text string")
    assert [r["chunk_id"] for r in retrieval.auto_merge(kids, parents, 0.5).orderBy(F.desc("score")).collect()] == ["b", "p1", "a"]
    assert [r["chunk_id"] for r in retrieval.auto_merge(kids, parents, 1.0).orderBy(F.desc("score")).collect()] == ["b", "c1", "a"]
    seg = spark.createDataFrame([(1, i, c, "two words") for i, c in enumerate("abc")], "query_id int, ord int, chunk_id string, text string")
    got = retrieval.assemble_context(seg, 4).first()
    assert (got["context_tokens"], got["included"], got["text"]) == (4, "a,b", "two words\n\ntwo words")
    assert retrieval.assemble_context(seg, 1).first()["included"] == "a"
    hops = spark.createDataFrame([(1, 0, 0, "m1", "x"), (1, 0, 1, "m2", "x"), (1, 0, 2, "m3", "x"), (1, 1, 0, "n1", "x")], "query_id int, hop int, idx int, chunk_id string, text string")
    assert retrieval.assemble_hops(hops, 2).first()["included"] == "m1,n1"


def test_mmr(spark):
    items = spark.createDataFrame([(1, 0, "a", 0.9, "red car fast"), (1, 1, "b", 0.88, "red car fast"), (1, 2, "c", 0.4, "blue sky")], "query_id int, ord int, chunk_id string, score double, text string")
    order = lambda **k: [r["chunk_id"] for r in retrieval.maximal_marginal_relevance(items, **k).orderBy("mmr_rank").collect()]
    assert order(k=2, weight=0.1) == ["a", "c"] and order(k=3, weight=4.0) == ["a", "b", "c"]


def test_grid(spark):
    head = [(0, 0, True, "NAM", None), (0, 1, True, "2025", None), (0, 2, True, None, None), (1, 1, True, "Q1", None), (1, 2, True, "Q2", None)]
    cells = spark.createDataFrame([("g", *c) for c in [*head, (2, 0, False, "B1", None), (2, 1, False, "4,6%", None), (2, 2, False, "5,8%", "red")]], "grid_id string, row int, col int, header boolean, text string, color string")
    assert [r["line"] for r in layout.describe_grid(cells).collect()] == ["B1 │ 2025 · Q1: 4,6% │ 2025 · Q2: 5,8% [red]"]


def test_boxes(spark):
    box = lambda l, t, r, b: F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("ltrb", (l, t, r, b))])  # noqa: E731, E741
    assert tuple(_one(spark, layout.to_bottom_left(box(50, 70, 560, 116), F.lit(792.0)))) == (50, 722, 560, 676)
    assert tuple(_one(spark, layout.to_bottom_left(box(50, 70, 560, 116), F.lit(0.0)))) == (50, 70, 560, 116)

    def merged(*tops):
        rows = [(1, 0, k, (10.0, float(t), 90.0, float(t - 8))) for k, t in enumerate(tops)]
        df = spark.createDataFrame(rows, "span_id int, page int, ord int, bbox struct<l:double,t:double,r:double,b:double>")
        return sorted((r["b"], r["t"]) for r in layout.merge_regions(df).collect())

    assert merged(18, 28, 38, 608) == [(10, 38)] and merged(18, 28, 608, 618) == [(10, 28), (600, 618)]


def test_text_layer_and_furniture(spark):
    box = "struct<l:double,t:double,r:double,b:double>"
    lines = spark.createDataFrame([(1, 0, 0, "a whole line", (0.0, 20.0, 100.0, 0.0)), (1, 0, 1, "x", (10.0, 15.0, 14.0, 5.0)), (1, 0, 2, "y", (200.0, 15.0, 204.0, 5.0)), (1, 0, 3, "thin", (0.0, 1.0, 50.0, 0.0))], f"doc_id int, page int, ord int, text string, bbox {box}")
    assert sorted(r["ord"] for r in layout.text_layer(lines).collect()) == [0, 2]
    pages = spark.createDataFrame([(1, p, o, t, (0.0, 10.0, 50.0, 0.0)) for p in range(4) for o, t in enumerate(("Header", f"body {p}"))], f"doc_id int, page int, ord int, text string, bbox {box}")
    assert {r["text"] for r in layout.drop_furniture(pages).collect()} == {f"body {p}" for p in range(4)}


def test_table_chunks(spark):
    blocks = spark.createDataFrame([(1, 0, "caption", "Cap"), (1, 1, "table", "Name|Age"), (1, 2, "table", "Alice|30"), (1, 3, "table", "Bob|25"), (1, 4, "text", "prose")], "doc_id int, ord int, kind string, text string").withColumn("self_labeled", F.lit(False))
    s = chunking.segmentize(layout.position_blocks(blocks))
    assert [r["text"] for r in chunking.table_chunks(s).orderBy("part").collect()] == ["Cap\nName|Age\nAlice|30\nBob|25", "Cap\nName|Age\nAlice|30", "Cap\nName|Age\nBob|25"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#é", max_size=300), st.sampled_from(sorted(chunking.SPLITTERS)), st.integers(5, 60), st.integers(0, 4))
def test_chunks_are_found_in_their_text(text, name, size, overlap):
    chunks = chunking.SPLITTERS[name](text, size, overlap)
    spans = chunking.locate(text, chunks, overlap)
    assert all(0 <= s <= e <= len(text) for s, e in spans if s >= 0)
    if name != "token":
        assert all(len(c) <= size for c in chunks)
    assert [s for s, _ in spans if s >= 0] == sorted(s for s, _ in spans if s >= 0)


def test_locate_with_other_white_space():
    assert chunking.locate("a  b\nc d", ["a b", "c d", "zzz"]) == [(0, 4), (5, 8), (-1, -1)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("q", "q"), ("", "z"), (None, "z")], "source string, target string")
    found = graph.communities(edges)
    assert {r["members"] for r in graph.community_sizes(found).collect()} == {"a, b, c", "x, y"}
    assert graph.is_degenerate(found.where("false")).first()["degenerate"] is True
    vectors = spark.createDataFrame([("near", [1.0, 0.05]), ("mid", [1.0, 1.0]), ("far", [0.0, 1.0]), ("none", None)], "name string, vec array<double>")
    assert [r["name"] for r in graph.rank_by_similarity(vectors, [1.0, 0.0], 5).orderBy("rank").collect()] == ["near", "mid"]
    raw = '{"entities":[{"name":"C"},{"name":"2025"},{"name":"15.000"},{"name":"Green SM","type":"org"},{"name":"GSM_KD11"}],"relationships":[{"source":"Green SM","target":"GSM_KD11"},{"source":"GSM_KD11","target":"Green SM"},{"source":"a","target":"a"}]}'
    out = graph.parse_extraction(spark.createDataFrame([(1, f"```json\n{raw}\n```", None), (2, "not json", None)], "chunk_id int, raw string, passage string")).orderBy("chunk_id").collect()
    assert [e["name"] for e in out[0]["entities"]] == ["Green SM", "GSM_KD11"] and len(out[0]["relationships"]) == 1 and out[1]["entities"] == []
    entities, edges = graph.parse_reply('{"entities":[{"name":"Vinpearl Phu Quoc"},{"name":"Absent"}],"relationships":[{"source":"Vinpearl","target":"Nowhere"}]}', "At Vinpearl Phu Quoc")
    assert [n for n, _ in entities] == ["Vinpearl Phu Quoc"] and edges == []
    q = spark.createDataFrame([(1, "What does Green SM charge?"), (2, "common charge")], "query_id int, text string")
    names = spark.createDataFrame([("Green SM",), ("Airport surge charge fee",)], "name string")
    assert [tuple(r) for r in graph.match_entity_names(q, names).collect()] == [(1, "Green SM")]


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "else"), (4, None)], "doc_id int, text string")
    classes = store.print_classes(docs)
    assert sorted((r["doc_id"], r["class_id"]) for r in classes.collect()) == [(1, 1), (2, 1), (3, 3)] and store.near_pairs(classes).count() == 0
    assert store.open_index(spark, str(tmp_path / "none"), "chunk_id string").count() == 0
    cache = spark.createDataFrame([], "key string, vector array<double>, cached_at timestamp")
    assert store.embed_texts(docs, cache, "m", T.stub_embedding).count() == 2


def test_texts_are_normalized_in_one_pass(spark, small):
    texts = spark.createDataFrame([("e\u0301",), ("\u00e9",), ("plain",), ("plain",), ("",), (None,)], "text string")
    assert sorted(r["text"] for r in store.distinct_texts(texts).collect()) == ["", "plain", "\u00e9"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert store.distinct_texts(docs)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    prints += [p ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for p in prints[:40] for k in (1, 2, 3, 4)]
    prints = list(dict.fromkeys(prints))
    classes = spark.createDataFrame(list(enumerate(prints)), "class_id int, h bigint")
    for radius in (0, 1, 3, 4):
        want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= radius}
        assert {(r["a"], r["b"]) for r in store.near_pairs(classes, radius).collect()} == want


def test_near_pairs_are_not_broadcast(spark):
    """A class has twenty keys, of which the estimate of their size knows nothing: 5 MB of prints became 0.5 GB."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    classes = spark.createDataFrame([(i, i, h) for i, h in enumerate((0, 1, 7, -1, -(2**63), 0b1111))], "doc_id long, class_id long, h long")
    pairs = store.near_pairs(classes)
    assert {tuple(r) for r in pairs.collect()} == {(0, 1, 1), (0, 2, 3), (0, 4, 1), (1, 2, 2), (1, 4, 2), (1, 5, 3), (2, 5, 1)}
    assert "Broadcast" not in plan(pairs) and "SortMergeJoin" in plan(pairs)
    docs = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "c")], "doc_id long, text string")
    assert "Broadcast" not in plan(store.print_classes(docs))


def test_searches_in_blocks_of_queries(spark):
    """Many blocks find what one does, and what a scan written out finds; ids may be strings, vectors of any length."""
    words = "red blue green grey dark light deep pale".split()
    rng = np.random.default_rng(9)
    docs = [(f"c{i}", " ".join(rng.choice(words, 6)), [float(x) for x in rng.normal(size=3)] if i % 9 else None) for i in range(60)]
    chunks = spark.createDataFrame(docs + [("z", None, [0.0, 0.0, 0.0]), ("y", "", [1.0])], "chunk_id string, text string, vector array<double>")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 2)), [float(x) for x in rng.normal(size=3)]) for i in range(12)] + [(99, None, None)], "query_id int, text string, vector array<double>")
    rows = lambda df: {tuple(r) for r in df.collect()}
    one, many = retrieval.bm25_topk(chunks, asked, 5), retrieval.bm25_topk(chunks, asked, 5, block_bytes=20)
    assert rows(one) == rows(many) and len(rows(one)) >= 50
    near, parts = retrieval.knn_topk(chunks, asked, 5), retrieval.knn_topk(chunks, asked, 5, block_bytes=50)
    assert rows(near) == rows(parts)
    for q, _, v in asked.collect():
        cosine = lambda x: 0.0 if not v or not x or len(x) != len(v) or not any(x) else float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v))  # noqa: B023, E731
        want = sorted(((-round((1 + cosine(r["vector"])) / 2, 9), r["chunk_id"]) for r in chunks.collect()))[:5]
        found = near.where(F.col("query_id") == q).orderBy("rank").collect()
        assert [r["chunk_id"] for r in found] == [c for _, c in want] and [-r["score"] for r in found] == pytest.approx([s for s, _ in want])
    got = retrieval.retrieve(chunks, asked.drop("vector"), embed=lambda c: F.array(F.length(c).cast("double"), F.lit(1.0), F.lit(0.0)), keyword=False)
    assert got.where("bm25_rank IS NOT NULL").count() == 0 and got.where("rerank_score IS NULL").count() == got.count() > 0
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, asked.drop("vector"))


def test_scores_take_bounded_memory():
    """A thousand rows of fifty terms that all of 200 queries have: ten million numbers, of which few are made at once."""
    import tracemalloc

    import pyarrow as pa

    from loomspark.operators.shared import NUMBERS, Holders

    names = [f"t{i:02d}" for i in range(50)]
    rng, holders, n = np.random.default_rng(3), Holders([names] * 200), 1000
    many = rng.integers(1, 9, (n, 50)).astype(np.int32)
    listed = lambda x: pa.ListArray.from_arrays(np.arange(0, 50 * n + 1, 50, dtype=np.int32), x.ravel())
    whole = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(many.sum(1).astype(np.int64)), listed(np.tile(np.arange(50, dtype=np.int32), (n, 1))), listed(many)], ["chunk_id", "size", "terms", "counts"])
    tracemalloc.start()
    best, rows = np.zeros(n), 0
    for part, score in retrieval._bm25_scores(whole, holders, np.ones(50), 200.0, 1.2, 0.75):
        assert score.shape == (200, part.num_rows) and part.num_rows * 50 * 200 <= NUMBERS
        best[rows : rows + part.num_rows], rows = score[0], rows + part.num_rows
        assert (score == score[0]).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    weight = 1.2 * (0.25 + 0.75 * many.sum(1, keepdims=True) / 200)
    assert rows == n and best == pytest.approx((many * 2.2 / (many + weight)).sum(1)) and peak < 100e6


def test_batches_go_by_bytes_too(spark):
    from loomspark.operators import shared
    from loomspark.plans import catalog

    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    try:
        for name in names:
            spark.conf.unset(name)
        catalog._t(spark, "/root/testdata/sf0.001", "documents")

        def sizes(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

        batches = lambda df: [r["n"] for r in df.coalesce(1).mapInArrow(sizes, "n bigint").collect()]
        few, long = batches(spark.range(2000)), batches(spark.range(400).select(F.repeat(F.lit("x"), 100_000)))
        assert sum(few) == 2000 and max(few) <= 512 and sum(long) == 400 and max(long) <= 60
        spark.conf.set(names[0], "77")
        shared.short_batches(spark)
        assert spark.conf.get(names[0]) == "77"
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert list(shared.runs_within(np.array([3, 3, 9, 1, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 6)] and list(shared.runs_within(np.array([]), 6)) == []


def test_scores_are_not_told_apart_by_six_places(spark):
    legs = [spark.createDataFrame([(1, c, s, k) for k, (c, s) in enumerate(rows, 1)], LEG) for rows in ([("a", 0.5), ("b", 0.50000004), ("c", 0.1)], [("a", 1.0), ("b", 1.0), ("c", 1.0)])]
    assert [r["chunk_id"] for r in retrieval.fuse(*legs).orderBy("fused_rank").collect()] == ["b", "a", "c"]


def test_auto_merge_keeps_the_first_and_orders(spark):
    kids = spark.createDataFrame([(1, 0, "x", "p", 0.1, "t"), (1, 1, "x", "p", 0.9, "t"), (1, 2, "y", "q", 0.1, "t"), (1, 3, "s", None, 0.1, "t"), (1, 4, "u", "none", 0.1, "t")], "query_id int, ord int, chunk_id string, parent_id string, score double, text string")
    parents = spark.createDataFrame([("p", 9, "whole"), ("q", 1, "other"), ("r", 0, "empty")], "chunk_id string, child_count int, text string")
    got = retrieval.auto_merge(kids, parents).orderBy("position").collect()
    assert [(r["chunk_id"], r["score"], r["merged"]) for r in got] == [("s", 0.1, 0), ("u", 0.1, 0), ("x", 0.1, 0), ("q", 0.1, 1)]


def test_line_height_is_a_quarter_up(spark):
    rows = [(1, k, (0.0, float(h), 9.0, 0.0)) for k, h in enumerate((10, 10, 11, 12, 12, 12, 13, 13))] + [(2, k, (0.0, float(h), 9.0, 0.0)) for k, h in enumerate((10, 12, 60, 61))] + [(3, 0, None)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, bbox struct<l:double,t:double,r:double,b:double>")
    assert {r["doc_id"]: r["line_height"] for r in layout.line_height(df).collect()} == {1: 11.0, 2: 10.0}


def test_query_lists_as_json(spark):
    parse = lambda s: _one(spark, T.parse_query_list(F.lit(s), F.lit("q")))
    assert parse('[1,"a",{"x":2}]') == ["a"] and parse("[1, 2]") == ["q"] and parse("```alpha beta\n```") == ["alpha beta"] and parse('{"a": 1}') == ['{"a": 1}'] and parse("[broken") == ["[broken"]


def test_page_counts_are_those_of_the_patterns(spark):
    texts = ["plain text", "\ufeff  edges \u3000", "ctrl\x01\x9f\u200b\ue000\ufffd", "日本語 Ελ кир ñ × עברית", "", None, "𐐀𐐁 \U000e0041 ok", "a\tb\nc\x0b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    trimmed = T.js_trim(F.coalesce("t", F.lit("")))
    share = lambda a, b, none: F.coalesce(F.try_divide(F.col(f"c.{a}"), F.col(f"c.{b}")), F.lit(none))
    rows = df.withColumn("c", T.page_counts(F.col("t"))).select(F.length(trimmed) == F.col("c.size"), T.ctrl_ratio(trimmed) == share("control", "size", 0.0), T.valid_frac(trimmed) == share("readable", "letters", 1.0)).collect()
    assert all(all(r) for r in rows)


def test_page_counts_take_bounded_memory():
    """Many texts, and one of three million characters, a part at a time; empty ones between them count nothing."""
    import tracemalloc

    import pandas as pd

    texts = pd.Series(["", None, " ab1\x01 "] + ["née 1 " * 5000] * 200 + [" "] + ["x\u200b" * 1_500_000, "жд"])
    T.count_kinds(texts[:3])  # makes the table
    tracemalloc.start()
    got = T.count_kinds(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    assert got.iloc[[0, 1, 2, 3, 202, 203, 204, 205]].values.tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [4, 1, 2, 2], [29999, 0, 15000, 15000], [29999, 0, 15000, 15000], [0, 0, 0, 0], [3_000_000, 1_500_000, 1_500_000, 1_500_000], [2, 0, 2, 2]]


def test_canonical_json():
    assert runs.canonical({"b": [1, 2.0, None, "é"], "a": {"z": True, "y": 0.5}, "ﬁ": float("nan"), "𐀀": 1}) == '{"a":{"y":0.5,"z":true},"b":[1,2,null,"é"],"𐀀":1,"ﬁ":null}'


def test_tools_have_bounds(spark):
    items = spark.createDataFrame([(1, i, 0.5, "t") for i in range(201)], "query_id int, ord int, score double, text string")
    with pytest.raises(ValueError):
        runs.TOOLS["diversify-candidates"](items)
    with pytest.raises(ValueError):
        runs.TOOLS["assemble-context"](items.where("ord < 3").withColumn("chunk_id", F.col("ord")), -1)
    replies = spark.createDataFrame([(1, '["a"]')], "query_id int, text string")
    assert runs.TOOLS["parse-query-list"](replies).first()["queries"] == ["a"]


def test_pages_without_a_route_and_forced_ones(spark):
    from loomspark.operators import pages

    block = "doc_id int, page int, ord int, text string"
    base = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b")], block)
    routes = spark.createDataFrame([(1, 2, "mineru")], "doc_id int, page int, route string")
    vlm = spark.createDataFrame([(1, 1, 0, "v1"), (1, 2, 0, "v2")], block)
    way = lambda **k: sorted((r["text"], r["engine"]) for r in pages.routed_blocks(base, routes, base.where("false"), vlm, **k).collect())
    assert way() == [("a", "fast"), ("v2", "vlm")] and way(pipeline="vlm") == [("v1", "vlm"), ("v2", "vlm")]


def test_caches(spark):
    from datetime import datetime

    rows = spark.createDataFrame([("k", "old", datetime(2000, 1, 1)), ("j", "new", datetime.now())], "key string, value string, cached_at timestamp")
    asked = spark.createDataFrame([("k",), ("j",), ("i",)], "key string")
    found = {r["key"]: r["value"] for r in store.cached(asked, rows, value="value").collect()}
    assert found == {"k": None, "j": "new", "i": None}
    kept = store.remember(rows, spark.createDataFrame([("k", "fresh")], "key string, value string"), value="value")
    assert {r["key"]: r["value"] for r in store.cached(asked, kept, value="value").collect()} == {"k": "fresh", "j": "new", "i": None}
    assert _one(spark, store.normalized(F.lit("e\u0301"))) == "é"
    docs = spark.createDataFrame([("e\u0301",), ("é",), ("bb",)], "text string")
    empty = spark.createDataFrame([], "key string, vector array<double>, cached_at timestamp")
    assert store.embed_texts(docs, empty, "m", T.stub_embedding).count() == 2
    with pytest.raises(ValueError):
        store.embed_texts(docs, empty, "m", lambda c: F.sequence(F.lit(1.0).cast("int"), F.length(c)).cast("array<double>")).count()


def test_built_chunks(spark):
    box = (0.0, 20.0, 100.0, 10.0)
    rows = [(1, 0, "text", "Intro words here", 1, box), (1, 1, "caption", "Cap", 1, box), (1, 2, "table", "h|i", 1, box), (1, 3, "table", "1|2", 1, box), (1, 4, "Table", "upper", 2, None)]
    blocks = spark.createDataFrame(rows, f"doc_id int, ord int, kind string, text string, page int, bbox {layout.BOX}").withColumn("self_labeled", F.lit(False))
    for strategy in ("recursive", "sentence", "character", "token", "markdown", "semantic", "nonsense"):
        got = chunking.build_chunks(blocks, strategy, 100, 10).orderBy("ord").collect()
        assert [r["text"] for r in got] == ["Intro words here", "Cap\nh|i\n1|2", "Cap\nh|i\n1|2", "upper"]
        assert [len(r["regions"]) for r in got] == [1, 2, 1, 0] and [r["rank"] for r in got] == sorted(r["rank"] for r in got)
    assert [r["text"] for r in chunking.build_chunks(blocks, "structural").orderBy("ord").collect()] == [r[3] for r in rows]
    embedded = chunking.with_context(spark.createDataFrame([(1, "t"), (2, "u")], "chunk_id int, text string"), spark.createDataFrame([(1, " about ")], "chunk_id int, context string"))
    assert {r["chunk_id"]: r["embedded"] for r in embedded.collect()} == {1: "about\n\nt", 2: "u"}
    assert "t" in chunking.chunk_prompt("t", "d") and "JSON" in runs.graph_prompt("p")


def test_costs_and_grades(spark):
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_price double, output_price double")
    m = spark.createDataFrame([("m", "metered", 3, 4), ("x", "free", 5, 5)], "model string, billing_mode string, input_tokens int, output_tokens int")
    assert {r["model"]: r["cost"] for r in runs.cost_of(m, prices).collect()} == {"m": 11.0, "x": 0.0}
    with pytest.raises(Exception, match="no price"):
        runs.cost_of(m.withColumn("billing_mode", F.lit("metered")), prices).collect()
    with pytest.raises(Exception, match="no price"):
        runs.cost_of(m.where("model = 'm'"), prices.withColumn("input_price", F.lit(None).cast("double"))).collect()
    done, took = runs.meter("s", lambda: m)
    assert done.count() == 2 and took["error"] is None and runs.meter("s", lambda: m.select("nope"))[1]["error"]
    a = spark.createDataFrame([("q", "fee is 5", "5", "7"), ("q", "5 or 7", "5", "7"), ("q", None, "5", "")], "question string, answer string, expect string, reject string")
    assert [r["grounded"] for r in runs.grade(a).collect()] == [True, False, False]


def test_html():
    table = '<div data-bbox="0 0 500 500" data-label="Table"><table><tr><th rowspan="2">Car</th><th colspan="2">Discount</th></tr><tr><th>Retail</th><th>Corp</th></tr><tr><td>A</td><td>15%</td><td>4%</td></tr></table></div>'
    blocks = html.page_blocks(table + '<p data-bbox="0 500 1000 600">hello   <b>there</b></p>')
    assert [b[0] for b in blocks] == ["A │ Discount · Retail: 15% │ Discount · Corp: 4%", "hello", "there"]
    assert blocks[0][2] == (0, 792, 306, 396) and blocks[0][3]
    assert html.page_blocks("<p>only <script>var x='</p>'</script>text</p>") == [("only text", "text", None, False)]
    assert len(html.page_blocks('<p data-bbox="1 1 2 2">x</p>' * 50)) == 1 and html.page_blocks(None) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,score\nAda,91\n\nGrace,8|8")
    (tmp_path / "b.txt").write_text("one\n\n\n two \nmore")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.htm").write_text("<h1>Title</h1>")
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "d.xlsx").write_bytes(sheet.getvalue())
    rows = {}
    for r in files.read_blocks(spark, str(tmp_path)).orderBy("path", "ord").collect():
        rows.setdefault(r["path"][-5], []).append(r)
    assert [(r["text"], r["row"]) for r in rows["a"]] == [("name | score", 1), ("Ada | 91", 2), ("Grace | 8\\|8", 4)]
    assert [r["text"] for r in rows["b"]] == ["one", "two \nmore"] and "no parser" in rows["c"][0]["error"]
    assert any(r["text"] == "Title" and r["engine"] == "office" for v in rows.values() for r in v)
    assert any(r["text"] == "head |  | 5" and r["row"] == 2 for v in rows.values() for r in v)


def test_pixels(spark):
    green = bytes([197, 223, 150] * 100)
    assert pixels.dominant(green, 3) == (197, 223, 150) and pixels.dominant(bytes([255] * 300), 3) is None
    assert pixels.neutral(bytes([200] * 300), 3) == (200, 200, 200) and pixels.neutral(bytes([255] * 300), 3) is None
    assert pixels.respace("GIÁCƯỚC TAXI", ["GIÁ", "CƯỚC"]) == "GIÁ CƯỚC TAXI" and pixels.respace("ABCDEFG", ["XY"]) == "ABCDEFG"
    plane = np.full((100, 50), 255, np.uint8)
    plane[40:44] = 0
    assert pixels.snap(plane, 40, 50, 0, 50) == 0 and pixels.snap(plane, 46, 56, 0, 50) is not None and pixels.snap(plane, 80, 90, 0, 50) is None


def test_config():
    with pytest.raises(ValueError):
        config.RetrieveConfig(top_k=51)
    with pytest.raises(ValueError):
        config.Provider("p")
    p = config.Provider("p", base_url="http://x", models={"embed": ["m"]})
    assert config.resolve_ref({"p": p}, "p:m", "embed")[1] == "m" and config.default_ref({"p": p}, "rerank") is None


def test_stream_equals_table(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    want = {tuple(r) for r in ingest.event_counts(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{small}/events.parquet*")
    q = ingest.event_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counted").collect()} == want


def test_stream_drops_repeats(spark, tmp_path):
    from datetime import datetime

    spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1))], "text string, ts timestamp").write.parquet(str(tmp_path / "in"))
    q = ingest.once(spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2
