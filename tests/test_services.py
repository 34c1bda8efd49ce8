"""What stands around services, with stand-ins for them, and the host's runtime."""

import pytest
from pyspark.sql import functions as F

from loomspark import config, runtime
from loomspark.functions import shapes
from loomspark.operators import layout, pixels, runs, store
from loomspark.sources import services


def _pages(spark, *images):
    return spark.createDataFrame([(1, k, i, 612.0, 792.0) for k, i in enumerate(images)], "doc_id int, page int, image binary, width double, height double")


def _reader():
    def read(image):  # made here, so that it reaches the workers by value
        if image == b"bad":
            raise ValueError("unreadable")
        return {b"boxed": '<p data-bbox="0 0 1000 500">hello</p>', b"plain": "<p>only text</p>", b"low": '<p data-bbox="0 0 1000 1000">tile</p>'}.get(bytes(image), "")

    return read


def test_pages_are_read_one_by_one(spark):
    got = services.read_pages(_pages(spark, b"boxed", b"bad", b"plain"), _reader(), tiles=lambda image, low, high: b"low" if low == 0 else b"bad", pause=0).orderBy("page", "ord").collect()
    assert [(r["text"], r["error"]) for r in got] == [("hello", None), (None, "unreadable"), ("tile", None)]
    assert tuple(got[0]["bbox"]) == (0, 792, 612, 396) and tuple(got[2]["bbox"]) == (0, 396, 612, 0) and got[2]["engine"] == "vlm"
    assert services.read_pages(_pages(spark, b"plain"), _reader(), pause=0).first()["bbox"] is None
    with pytest.raises(Exception, match="no page"):
        services.read_pages(_pages(spark, b"bad", b"bad"), _reader(), pause=0).collect()
    assert services.render_scale(100, 100) == 2 and services.render_scale(3200, 100) == 0.5


def test_layout_engine_and_regions(spark):
    blocks = services.layout_blocks(_pages(spark, b"x"), lambda image: [{"text": "t", "bbox": (10, 20, 30, 40)}, {"text": "u", "kind": "title"}]).orderBy("ord").collect()
    assert tuple(blocks[0]["bbox"]) == (10, 772, 30, 752) and (blocks[0]["kind"], blocks[1]["kind"], blocks[1]["bbox"]) == ("text", "title", None)
    regions = spark.createDataFrame([(1, b"file", 3, (1.0, 2.0, 3.0, 4.0))], f"id int, content binary, page int, bbox {layout.BOX}")
    assert services.read_regions(regions, lambda c, p, b: f"<p>{c.decode()} {p} {b[3]}</p>".encode(), lambda i: i.decode()).first()["text"] == "file 3 4.0"


def test_files_are_converted_and_text_layers_read(spark):
    files = spark.createDataFrame([("a.docx", b"word"), ("b.pdf", b"%PDF1"), ("c.ppt", b"broken")], "path string, content binary")

    def convert(content, path):
        if content == b"broken":
            raise ValueError("can't")
        return b"%PDF" + content

    out = services.converted(files, convert)
    assert {r["path"]: (r["content"] and bytes(r["content"]), r["error"]) for r in out.collect()} == {"a.docx": (b"%PDFword", None), "b.pdf": (b"%PDF1", None), "c.ppt": (None, "can't")}
    lines = lambda c: [(p, t, (0.0, 20.0, 100.0, 10.0)) for p in range(1, 5) for t in ("Header", f"{c.decode()} {p}")]
    got = services.text_layers(files.unionByName(out.where("error IS NULL AND path = 'a.docx'").select("path", "content")), lines).collect()
    assert sorted(r["text"] for r in got) == sorted(f"%PDF{x} {p}" for x in ("1", "word") for p in range(1, 5))


def test_words_become_blocks():
    html = '<table><tr><td><p><span data-bbox="10 20 30 40">a</span> <b data-bbox="50 20 70 45">b</b></p></td></tr></table><span data-bbox="0 0 5 5">lone &amp; x</span><i data-bbox="1 2 nan">no</i>'
    out = services.words_to_blocks(html, 100, 200)
    assert out == '<div data-bbox="100 100 700 225" data-label="text">a b</div>\n<div data-bbox="0 0 50 25" data-label="text">lone &amp; x</div>'
    assert services.words_to_blocks(html, 0, 5) == html


def test_polling():
    states = iter([(False, None), (False, None), (True, "done")])
    assert services.poll(lambda: 7, lambda job: next(states), sleep=lambda s: None) == "done"
    now = iter(range(0, 10_000, 400))
    with pytest.raises(TimeoutError):
        services.poll(lambda: 7, lambda job: (False, None), clock=lambda: next(now), sleep=lambda s: None)


def test_runtime(monkeypatch):
    with pytest.raises(ValueError):
        runtime.configure(PROVIDERS_FILE="x")
    monkeypatch.setattr(runtime, "_settings", None)
    monkeypatch.delenv("PROVIDERS_FILE", raising=False)
    with pytest.raises(LookupError):
        runtime.setting("PROVIDERS_FILE")
    runtime.configure(PROVIDERS_FILE="x", DOCUMENT_SERVICE_URL="u", LOOM_STUBS=True)
    assert runtime.setting("PROVIDERS_FILE") == "x" and runtime.stubbed() and runtime.setting("OTHER") is None
    ring = runtime.Ring(3)
    for k in range(5):
        ring.add(k=k, deep={"token": "t", "list": [{"apiKey": "s", "kept": 1}]})
    assert [e["k"] for e in ring.recent()] == [2, 3, 4] and ring.recent(1)[0]["deep"] == {"token": "[redacted]", "list": [{"apiKey": "[redacted]", "kept": 1}]}
    assert '"k": 4' in ring.lines()[-1]
    runtime.record_stage({"stage": "chunk", "duration_ms": 1.0, "error": None}, model="m")
    assert runtime.SPANS.recent(1)[0]["name"] == "stage.chunk"
    assert runtime.map_pool(range(20), 4, lambda x: x * x) == [x * x for x in range(20)] and runtime.map_pool([], 4, str) == []
    with pytest.raises(AssertionError):
        runtime.invariant(False, "no")
    monkeypatch.setattr(runtime, "_settings", None)


def test_models_by_role():
    p = {"a": config.Provider("a", base_url="http://x", models={"embed": ["m"], "chat": []}), "b": config.Provider("b", vertex="v", models={"chat": ["c"]})}
    listed = lambda q: ["big-chat", "text-embed", "some-tts"]
    assert config.list_models_by_role(p, "chat", listed) == ["a:big-chat", "b:c"] and config.list_models_by_role(p, "chat") == ["b:c"]
    assert config.assert_served(p, {"embed": "a:m", "chat": "b:c"}) is None and "a:z" in config.assert_served(p, {"embed": "a:z"})
    assert config.model_identity(p, "a:m") == ("a", "http://x") and config.role_allows_model("rerank", "x-ranker") and not config.role_allows_model("rerank", "frank")
    with pytest.raises(LookupError):
        config.model_identity(p, "zz:m")


def test_shapes(spark):
    cells, asked = shapes.dense_two_headers(spark)
    lines = [r["line"] for r in layout.describe_grid(cells).orderBy("row").collect()]
    for r in asked.collect():
        zone, tier = r["query_id"] % 3 + 1, r["query_id"] % 2 + 1
        assert f"Zone {zone} · Tier {tier}: {r['expect']}" in lines[r["query_id"]] and r["expect"] != r["reject"]
    cells, asked = shapes.multilevel_table(spark)
    (line,) = [r["line"] for r in layout.describe_grid(cells).collect()]
    assert all(r["expect"] in line for r in asked.collect()) and "2021 · Q3 · Actual" in line
    assert [layout.is_degenerate_ocr(shapes.scan_page(spark, degenerate=d)).first()["degenerate"] for d in (False, True)] == [False, True]
    for docs, asked in (shapes.band_table(spark), shapes.two_hops(spark)):
        everything = " ".join(r["text"] for r in docs.collect())
        graded = runs.grade(asked.withColumn("answer", F.lit(everything)).withColumn("reject", F.lit("")))
        assert graded.where("NOT grounded").count() == 0


def test_index_appends(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, text string")
    assert store.append(rows, str(tmp_path / "i")) == 2 and store.append(rows.where("chunk_id = 1").withColumn("chunk_id", F.lit(3)), str(tmp_path / "i")) == 1
    with pytest.raises(ValueError):
        store.append(rows.unionByName(rows), str(tmp_path / "i"))
    assert store.open_index(spark, str(tmp_path / "i"), "chunk_id int, text string").count() == 3
    wide = store.ensure_vector_field(rows, "m")
    assert wide.columns[-1] == "vec_62c66a7a5dd70c31" and store.ensure_vector_field(wide, "m").columns == wide.columns


def test_cell_color_name(spark):
    cells = spark.createDataFrame([(bytes([130, 220, 150] * 100), 3), (bytes([255] * 300), 3), (None, 3)], "pixels binary, comps int")
    assert [r["c"] for r in cells.select(pixels.cell_color_name(F.col("pixels"), F.col("comps")).alias("c")).collect()] == ["green", None, None]
