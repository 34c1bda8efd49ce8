import base64
import hashlib
import random

import numpy as np
import pytest

from loomspark.llm import ann, warc, webp

VECTORS = "id int, v string, vec_id bigint, embedding array<float>, cell int"


def _rows(x, first=0):
    return [(7, "x", first + i, [float(e) for e in v], 1) for i, v in enumerate(x)]


def _found(df):
    out: dict[int, list[tuple[int, float]]] = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append((r["neighbor_id"], r["similarity"]))
    return out


def test_ann_recall_against_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(1500, 16)).astype(np.float32)
    params = ann.AnnParams(k=5, list_size=32, cell_rows=400)
    got = _found(ann.neighbours(spark.createDataFrame(_rows(x), VECTORS), params))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert len(got) == 1500 and all(len(v) == 5 for v in got.values())
    assert all(i not in [n for n, _ in v] for i, v in got.items())
    assert sum(len({n for n, _ in got[i]} & set(want[i].tolist())) for i in range(1500)) / 7500 >= 0.9


def test_ann_scans_what_the_ratio_selects(spark):
    x = np.random.default_rng(4).normal(size=(2500, 48)).astype(np.float32)
    params = ann.AnnParams(k=5, list_size=16, replicas=2, closure=1.3, prune=1.5, beam=8, cell_rows=800)
    got = _found(ann.neighbours(spark.createDataFrame(_rows(x), VECTORS), params))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert sum(len({n for n, _ in got[i]} & set(want[i].tolist())) for i in range(2500)) / 12500 >= 0.95


def test_ann_asked_ids_on_the_embeddings(spark):
    """The registered query against brute force: every id divisible by 50 asks, among all rows."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = _found(ann.op1_ann(spark, "/root/testdata/sf0.1"))
    asked = ids[ids % 50 == 0]
    assert sorted(got) == sorted(asked.tolist())
    hit = 0
    for i in asked:
        s = x @ x[ids == i][0]
        s[ids == i] = -2
        hit += len({n for n, _ in got[i]} & set(ids[np.argsort(-s)[:10]].tolist()))
    assert hit >= 0.9 * 10 * len(asked)


def test_ann_lists_are_balanced_and_prune(spark):
    """Where vectors have structure few lists are scanned; only boundary vectors are copied and no list grows far."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(60, 1, 24)) * 2 + rng.normal(size=(60, 100, 24))).reshape(-1, 24).astype(np.float32)
    got = ann.profile(spark.createDataFrame(_rows(x), VECTORS))
    assert got["share"] < 0.25 and 1.0 < got["copies"] < 2 and got["longest"] <= 3 * ann.AnnParams().list_size


def test_ann_ratio_selects_against_brute_force():
    rng = np.random.default_rng(5)
    c = (rng.normal(size=(40, 1, 12)) * 4 + rng.normal(size=(40, 30, 12))).reshape(-1, 12).astype(np.float32)
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    graph = ann.CentroidGraph(c, np.argsort(d, axis=1)[:, 1:17])
    q = c[::17] + rng.normal(size=(len(c[::17]), 12)).astype(np.float32)
    far = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
    for prune in (1.05, 1.5, 4.0, 50.0):
        want = [set(np.flatnonzero(f <= prune * f.min())) for f in far]
        got = [set(g.tolist()) for g in graph.within(q, 8, prune)]
        assert sum(len(g & w) for g, w in zip(got, want)) >= 0.98 * sum(map(len, want))
    assert all(len(w) == len(c) for w in want) and got == want


def test_ann_several_indexes_find_the_same(spark):
    x = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame(_rows(x), VECTORS)
    one = _found(ann.neighbours(df, ann.AnnParams(k=3, list_size=32)))
    many = _found(ann.neighbours(df, ann.AnnParams(k=3, list_size=32, graph_bytes=300)))
    assert sum(len({n for n, _ in one[i]} & {n for n, _ in many[i]}) for i in one) / 900 >= 0.9


def test_ann_copies_ties_and_bad_rows(spark):
    same = [(0, "", i, [1.0, 0.0], 0) for i in range(9)]
    bad = [(0, "", None, [1.0, 1.0], 0), (0, "", 100, None, 0), (0, "", 101, [0.0, 0.0], 0), (0, "", 102, [float("nan"), 1.0], 0), (0, "", 103, [1.0], 0), (0, "", 104, [None, 1.0], 0), (0, "", 105, [], 0)]
    other = [(0, "", 50, [0.0, 1.0], 0), (0, "", 50, [0.0, 1.0], 0), (0, "", 51, [0.6, 0.8], 0)]
    got = _found(ann.neighbours(spark.createDataFrame(same + bad + other, VECTORS), ann.AnnParams(k=3)))
    assert set(got) == {*range(9), 50, 51}
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0)] and got[8] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert got[50] == [(51, 0.8), (0, 0.0), (1, 0.0)] and got[51] == [(50, 0.8), (0, 0.6), (1, 0.6)]


def test_ann_empty(spark):
    assert ann.neighbours(spark.createDataFrame([], VECTORS)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(0, "", 1, [1.0], 0)], VECTORS)).count() == 0


def test_webp_known_file():
    width, height, pixels = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (width, height, len(pixels)) == (1, 1, 1)


def test_webp_predictions_by_fronts():
    """All modes, random residues: fronts against the rule pixel by pixel."""
    rng = np.random.default_rng(8)
    for width, height, bits in ((50, 24, 2), (64, 40, 3), (131, 33, 4), (48, 60, 2)):
        pixels = rng.integers(0, 2**32, width * height, dtype=np.uint32).tolist()
        modes = [int(m) << 8 for m in rng.integers(0, 16, webp._down(width, bits) * webp._down(height, bits))]
        assert webp._undo_by_fronts(pixels, width, height, bits, modes) == webp._undo_predictor(pixels, width, height, bits, modes)


def _image(rng, w, h, kind):
    if kind == 0:
        colours = [rng.getrandbits(32) for _ in range(rng.choice([1, 2, 4, 5, 17, 200]))]
        return [rng.choice(colours) for _ in range(w * h)]
    if kind == 1:
        return [(255 << 24) | ((x * 3 + y) % 256) << 16 | ((x + 2 * y) % 256) << 8 | (x * y % 256) for y in range(h) for x in range(w)]
    return [rng.getrandbits(32) for _ in range(w * h)]


def test_webp_round_trips():
    rng = random.Random(5)
    for _ in range(150):
        w, h, kind = rng.randint(1, 40), rng.randint(1, 25), rng.randrange(3)
        pixels = _image(rng, w, h, kind)
        features = webp.Features(
            predictor=tuple(rng.randrange(16) for _ in range(rng.randrange(5))), predictor_bits=rng.randint(2, 4), cross=tuple(tuple(rng.randint(-128, 127) for _ in range(3)) for _ in range(rng.randrange(3))),
            green=rng.random() < 0.5, palette=kind == 0 and rng.random() < 0.6, cache_bits=rng.choice([0, 1, 4, 11]), back_references=rng.random() < 0.7, group_bits=rng.choice([0, 2, 3]),
        )
        data = webp.encode(w, h, pixels, features)
        assert webp.decode(data)[2].tolist() == pixels, features
        for cut in (len(data) // 2, len(data) - 3):
            with pytest.raises(webp.WebPError):
                webp.decode(data[:cut])


def test_webp_bytes_that_lie_never_crash():
    rng = random.Random(6)
    good = webp.encode(9, 9, _image(rng, 9, 9, 1), webp.Features(predictor=(11,), cache_bits=3))
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(3):
            bad[rng.randrange(20, len(bad))] = rng.randrange(256)
        try:
            webp.decode(bytes(bad), most_pixels=10_000)
        except webp.WebPError:
            pass


def test_webp_table(spark):
    media = webp.encode(2, 1, [0xFF010203, 0x80AABBCC])
    rows = [(1, "a", bytearray(media)), (2, "b", None), (3, "c", bytearray(b"")), (4, None, bytearray(b"RIFFnothing")), (1, "a", bytearray(media))]
    out = webp.decode_images(spark.createDataFrame(rows, "k int, error string, media binary")).collect()
    assert out[0] == out[4] and (out[0]["width"], out[0]["height"], out[0]["error"]) == (2, 1, None)
    assert bytes(out[0]["pixels"]) == bytes([1, 2, 3, 255, 0xAA, 0xBB, 0xCC, 0x80])
    assert tuple(out[1])[1:] == (None,) * 4 and out[2]["error"] and out[3]["error"]
    assert webp.decode_images(spark.createDataFrame([], "media binary, pixels int")).columns == ["width", "height", "pixels", "error"]


def test_webp_icons_by_hash(spark):
    pages = spark.createDataFrame([(1, "http://a/"), (2, None), (3, "http://b/")], "page_id bigint, url string")
    for r in webp.decode_images(webp.page_icons(pages)).collect():
        want = None if r["page_id"] == 2 else webp.rgba(np.array(webp.icon(hashlib.md5({1: b"http://a/", 3: b"http://b/"}[r["page_id"]]).hexdigest()), np.uint32))
        assert (None if r["pixels"] is None else bytes(r["pixels"])) == want


RECORDS = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload string, digest int, _id int"


def _record(i, kind, uri, date, payload=None, digest=None):
    return (i, kind, uri, date, digest, payload, 1, 2)


def _sha(s):
    return hashlib.sha1(s.encode()).hexdigest()


def test_warc_resolution_and_round_trip(spark, tmp_path):
    rows = [
        _record("r1", "response", "http://a/", "2024-01-02", "page ü\r\n\r\nmore"), _record("r0", "response", "http://b/", "2024-01-01", "page ü\r\n\r\nmore"),
        _record("v1", "revisit", "http://a/", "2024-02-01", None, "SHA1:" + _sha("page ü\r\n\r\nmore").upper()), _record("v2", "revisit", "http://c/", None, None, "sha1:feed"), _record("v3", "revisit", None, None),
        _record("e", "response", "http://e/", None, ""), _record("n", "response", "http://n/", "2024-05-01", None), _record("r0", "response", "http://b/", "2024-01-01", "page ü\r\n\r\nmore"),
        _record("i", "warcinfo", None, None, "x"), _record(None, "response", "http://long/", "2024-01-01", "z" * 300_000),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    warc.write_archive(df, f"file://{tmp_path}/out")
    got = warc.read_archive(spark, f"file://{tmp_path}/out").collect()
    heads = {tuple(r) for r in warc.resolve(df).collect()}
    assert {tuple(r)[:8] for r in got} == heads and len(got) == len(heads) == 8
    by = {(r["target_uri"], r["warc_date"]): r for r in got}
    first = by["http://b/", "2024-01-01"]
    assert first["warc_type"] == "response" and bytes(first["payload"]).decode() == "page ü\r\n\r\nmore"
    for key in (("http://a/", "2024-01-02"), ("http://a/", "2024-02-01")):
        assert by[key]["warc_type"] == "revisit" and by[key]["refers_to"] == first["record_id"] and by[key]["refers_to_date"] == "2024-01-01"
    assert by["http://c/", None]["refers_to"] is None and by[None, None]["payload_digest"] is None
    assert by["http://n/", "2024-05-01"]["warc_type"] == "response" and by["http://e/", None]["refers_to"] == by["http://n/", "2024-05-01"]["record_id"]
    assert len(by["http://long/", "2024-01-01"]["payload"]) == 300_000


def test_warc_base32_digests_and_refers_to(spark):
    texts = [f"page {k}" for k in range(40)]
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    rows = [(*_record(f"r{k}", "response", f"http://{k}/", "2024-01-01", t, "sha1:" + b32(t)), None) for k, t in enumerate(texts)]
    rows += [(*_record(f"v{k}", "revisit", f"http://{k}/", "2024-02-01", None, ("sha1:", "", "SHA1:")[k % 3] + b32(t)), None) for k, t in enumerate(texts)]
    rows += [(*_record("w1", "revisit", "http://1/", "2024-03-01"), "<r1>"), (*_record("w2", "revisit", "http://2/", "2024-03-01"), "<none>"), (*_record("w3", "revisit", "http://3/", "2024-03-01", None, "sha1:" + _sha("page 3")), "r9")]
    got = {(r["target_uri"], r["warc_date"]): r for r in warc.resolve(spark.createDataFrame(rows, RECORDS + ", refers_to string")).collect()}
    assert len(got) == len(rows)
    for k in range(40):
        own, again = got[f"http://{k}/", "2024-01-01"], got[f"http://{k}/", "2024-02-01"]
        assert own["warc_type"] == "response" and again["refers_to"] == own["record_id"] and again["payload_digest"] == own["payload_digest"] == "sha1:" + _sha(texts[k])
    for k, known in ((1, True), (2, False), (3, True)):
        assert got[f"http://{k}/", "2024-03-01"]["refers_to"] == (got[f"http://{k}/", "2024-01-01"]["record_id"] if known else None)


def test_warc_reads_plain_archives(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nContent-Length: 9\r\n\r\nH\r\n\r\nbody\r\n\r\n")
    (got,) = warc.read_archive(spark, f"file://{tmp_path}").collect()
    assert (got["record_id"], bytes(got["payload"])) == ("urn:1", b"body")


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_batches_are_bounded_by_bytes(zipped):
    import gzip

    import pyarrow as pa

    payloads = [random.Random(k).randbytes(100_000) for k in range(90)]
    whole = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\nH\r\n\r\n%b\r\n\r\n" % (k, len(p) + 5, p) for k, p in enumerate(payloads))
    content = pa.py_buffer(gzip.compress(whole) if zipped else whole)
    full, slim = (list(warc._batches(content, x)) for x in (True, False))
    assert [x.as_py() for b in full for x in b.column("payload")] == payloads and len(full) > 1
    assert max(b.nbytes for b in full) <= warc.BATCH_BYTES + 200_000
    assert sum(b.num_rows for b in slim) == 90 and slim[0].schema.names == list(warc.COLUMNS) and max(b.nbytes for b in slim) < 100_000


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], RECORDS)
    assert warc.resolve(none).count() == 0
    warc.write_archive(none, f"file://{tmp_path}/none")


def test_warc_cut_short():
    import io

    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
