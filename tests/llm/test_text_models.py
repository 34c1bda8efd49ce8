import random

import numpy as np
import pytest

from loomspark.llm import quality, toxicity, url_filter
from loomspark.llm.common import table

DOCS = "doc_id bigint, text string, score double, _id bigint, toxic int, keep string"
LABELS = "doc_id bigint, quality int, toxic int, text string"
NICE = "river garden morning letter window bridge winter travel music harbour lemon forest".split()
FOUL = "scumbag idiotic moronic filthy loathsome vermin".split()


def _text(rng, foul=False, n=40):
    words = [rng.choice(NICE) for _ in range(n)]
    if foul:
        for _ in range(3):
            words[rng.randrange(n)] = rng.choice(FOUL)
    return " ".join(words)


def _corpus(spark, n=300, share=0.3, seed=3):
    rng = random.Random(seed)
    bad = [rng.random() < share for _ in range(n)]
    docs = spark.createDataFrame([(i, _text(rng, b), 0.0, 9, 7, "x") for i, b in enumerate(bad)], DOCS)
    labels = spark.createDataFrame([(i, 1 - int(b), int(b), "t") for i, b in enumerate(bad) if i < n * 2 // 3], LABELS)
    return docs, labels, bad


def test_toxicity_on_held_out_rows(spark):
    docs, labels, bad = _corpus(spark)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(docs, labels).collect()}
    wrong = [i for i in range(200, 300) if got[i] != bad[i]]
    assert len(wrong) <= 3
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, t in got.items() if not t}


def test_toxicity_scores_are_the_sum_of_weights(spark):
    docs, labels, _ = _corpus(spark, 90)
    model = toxicity.train(docs, labels)
    for r in toxicity.classify(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        low = r["text"].lower()
        grams = {low[i : i + n] for n in (3, 4, 5) for i in range(len(low) - n + 1)}
        slots = {int(model.grams.distinct(g)[-1]) if len(g) == 3 else None for g in grams} - {None}
        assert slots <= set(model.grams.distinct(low).tolist())
        assert r["score"] == pytest.approx(float(model.weights[np.unique(model.grams.distinct(low))].sum(dtype=np.float64)) + model.bias - model.threshold, abs=1e-6)


def test_toxicity_edges(spark):
    docs, labels, _ = _corpus(spark, 90)
    odd = spark.createDataFrame([(None, "river", 0.0, 1, 1, ""), (1000, None, 0.0, 1, 1, ""), (1001, "", 0.0, 1, 1, ""), (1002, "scumbag " * 60_000, 0.0, 1, 1, ""), (1002, "scumbag " * 60_000, 0.0, 1, 1, "")], DOCS)
    model_rows = toxicity.classify(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 1, ""), (1, None, None, "")], LABELS))).collect()
    assert len(model_rows) == 95
    by = {r["doc_id"]: r for r in model_rows}
    assert by[1000]["score"] is None and by[1000]["toxic"] is False and by[1002]["toxic"] and by[None]["toxic"] is False
    none = spark.createDataFrame([], DOCS)
    assert toxicity.classify(none, labels).count() == 0 and toxicity.keep_clean(docs, spark.createDataFrame([], LABELS)).count() == 90


def test_toxicity_on_the_tables(spark):
    """Labels are noisy: some rows labelled toxic have no toxic word. Those that have are found, clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    both = toxicity.classify(docs, labels).join(labels.select("doc_id", F_toxic().alias("is")), "doc_id").collect()
    assert sum(r["toxic"] and not r["is"] for r in both) <= 0.005 * len(both) and sum(r["is"] and r["toxic"] for r in both) >= 0.9 * sum(r["is"] for r in both)


def F_toxic():
    from pyspark.sql import functions as F

    return F.col("toxic") > 0


def test_quality_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    junk = lambda: "".join(rng.choice("@#%&*0123456789  xqz") for _ in range(200))
    good = [rng.random() < 0.7 for _ in range(400)]
    docs = spark.createDataFrame([(i, _text(rng) if g else junk(), 0.0, 1, 1, "") for i, g in enumerate(good)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0, "") for i in range(150) if good[i]], LABELS)
    model = quality.train(docs, labels)
    assert 0.5 <= model.prior <= 0.9
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert np.mean([got[i] == good[i] for i in range(150, 400)]) >= 0.9


def test_quality_keeps_good_documents_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    both = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r["keep"] for r in both if r["quality"]]) >= 0.97
    assert np.mean([r["keep"] for r in both if not r["quality"]]) <= 0.5


def test_quality_on_the_tables_at_its_own_boundary(spark):
    for sf, junk, lost in (("sf0.01", 0.1, 0.03), ("sf0.1", 0.1, 0.03)):
        docs, labels = table(spark, f"/root/testdata/{sf}", "documents"), table(spark, f"/root/testdata/{sf}", "labels")
        # no label of these rows is seen: only positives are trusted, and of them only the others
        held = labels.where("quality = 0 OR doc_id % 3 = 0")
        both = quality.classify(docs, labels.where("doc_id % 3 <> 0")).join(held, "doc_id").collect()
        assert np.mean([r["keep"] for r in both if not r["quality"]]) <= junk and np.mean([not r["keep"] for r in both if r["quality"]]) <= lost


def test_quality_against_brute_force(spark):
    """Cells, counts and the risk spelled out row by row; the fit has to reach a lower risk than its start and than shifts
    of its boundary."""
    rng = random.Random(12)
    junk = lambda: " ".join("".join(rng.choice("@#%&*0123456789XQZ") for _ in range(8)) for _ in range(30))
    texts = [_text(rng) if rng.random() < 0.7 else junk() for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 0.0, 1, 1, "") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int("#" not in t and "@" not in t), 0, "") for i, t in enumerate(texts) if i < 150], LABELS)
    model = quality.train(docs, labels)
    positive = [t for i, t in enumerate(texts) if i < 150 and "#" not in t and "@" not in t]
    loss = lambda z: 1 / (1 + np.exp(z))

    def risk(shift, scale=1.0):
        g = lambda ts: np.array([model.score(t) for t in ts]) * scale + shift
        return model.prior * loss(g(positive)).mean() + max(0.0, loss(-g(texts)).mean() - model.prior * loss(-g(positive)).mean())

    assert risk(0) < risk(0, 0.0) and risk(0) <= min(risk(5), risk(-5)) and abs(model.prior - 0.7) < 0.15
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert np.allclose([got[i] for i in range(300)], [model.score(t) for t in texts])
    local = quality.fit(positive, texts)
    assert np.allclose(local.weights, model.weights) and local.prior == model.prior


def test_quality_edges(spark):
    docs, labels, _ = _corpus(spark, 60)
    odd = spark.createDataFrame([(None, "river", 0.0, 1, 1, ""), (1000, None, 0.0, 1, 1, ""), (1001, "", 0.0, 1, 1, ""), (1002, "word " * 100_000, 0.0, 1, 1, ""), (5, "again", 0.0, 1, 1, "")], DOCS)
    rows = quality.classify(docs.unionByName(odd), labels).collect()
    assert len(rows) == 65 and [r["keep"] for r in rows if r["doc_id"] == 1000] == [False]
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0
    assert all(r["keep"] for r in quality.classify(docs, spark.createDataFrame([], LABELS)).collect())


def test_nn_pu_risk_never_goes_below_zero_for_long():
    rng = random.Random(6)
    model = quality.fit([_text(rng) for _ in range(60)], [_text(rng, foul=i % 2 == 0) for i in range(120)])
    assert np.isfinite(model.weights).all() and 0.01 <= model.prior <= 0.99


def test_estimated_prior_is_near_the_true_share():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.r_[rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)]
    assert abs(quality.estimate_prior(positive, unlabelled, 0.1) - 0.6) < 0.08


def test_url_filter(spark):
    urls = ["http://royal-casino.example.com/bonus", "https://www.history-museum.example.org/wiki/birds", None, "", "  ", "::not a url::", "http://[bad", "http://porn-hd.example.net/" + "x" * 100_000, "http://royal-casino.example.com/bonus"]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)], "page_id bigint, url string, html string, score double")
    rows = {r["page_id"]: r for r in url_filter.classify(pages).collect()}
    assert len(rows) == 9 and rows[0]["drop"] and rows[8]["score"] == rows[0]["score"] and not rows[1]["drop"]
    assert all(rows[i]["score"] is None and not rows[i]["drop"] for i in (2, 3, 4))
    assert url_filter.classify(spark.createDataFrame([], pages.schema)).count() == 0


def test_url_filter_own_training(spark):
    pages = spark.createDataFrame([(1, "http://alpha.test/a"), (2, "http://beta.test/b")], "page_id bigint, url string")
    training = spark.createDataFrame([("http://alpha.test/", 1), ("http://beta.test/", 0), (None, 1), ("x", None)], "url string, unwanted int")
    assert {r["page_id"]: r["drop"] for r in url_filter.classify(pages, training).collect()} == {1: True, 2: False}
    assert not any(r["drop"] for r in url_filter.classify(pages, training.where("unwanted = 1")).collect())


def test_url_filter_generalises():
    rows = url_filter.training_urls()
    rng = random.Random(2)
    rng.shuffle(rows)
    hosts = sorted({url_filter.host_and_path(u).split("$")[0] for u, _ in rows})
    held = set(rng.sample(hosts, len(hosts) // 5))
    model = url_filter.fit([r for r in rows if url_filter.host_and_path(r[0]).split("$")[0] not in held])
    test = [(u, y) for u, y in rows if url_filter.host_and_path(u).split("$")[0] in held and y == 0]
    assert np.mean([model.probability(u) < 0.65 for u, _ in test]) >= 0.9


def test_url_filter_finds_unwanted_hosts_it_has_not_seen():
    rows, threshold = url_filter.training_urls(), url_filter.UrlParams().threshold
    host = lambda u: url_filter.host_and_path(u).split("$")[0]
    hosts, found, kept = sorted({host(u) for u, _ in rows}), [], []
    for seed in range(3):
        held = set(random.Random(seed).sample(hosts, len(hosts) // 5))
        model = url_filter.fit([r for r in rows if host(r[0]) not in held])
        for u, y in rows:
            if host(u) in held:
                (found if y else kept).append((model.probability(u) >= threshold) == bool(y))
    assert np.mean(found) >= 0.8 and np.mean(kept) >= 0.95


def test_url_filter_on_the_pages(spark):
    """None of the table's unwanted hosts is in the training table."""
    unwanted = "casino-win free-bets ads-track spam-farm cheap-pills adult-x".split()
    own = {url_filter.host_and_path(u).split("$")[0] for u, _ in url_filter.training_urls()}
    assert not [h for h in own for u in unwanted if u in h]
    rows = url_filter.classify(table(spark, "/root/testdata/sf0.1", "pages")).collect()
    wrong = [r["url"] for r in rows if r["drop"] != any(u in r["url"] for u in unwanted)]
    assert len(wrong) <= 0.01 * len(rows)


def test_toxicity_against_brute_force():
    """The same model spelled out over sets of n-grams as strings, without hashing."""
    rng = random.Random(7)
    y = np.array([i % 3 == 0 for i in range(40)], float)
    texts = [_text(rng, bool(v), 12) for v in y]
    p = toxicity.ToxicityParams()
    sets = [{t[i : i + n] for n in range(p.low, p.high + 1) for i in range(len(t) - n + 1)} for t in texts]
    least = max(min(3, max(1, len(y) // 25)), int(p.min_share * min(y.sum(), (1 - y).sum())))
    names = sorted(g for g in set.union(*sets) if sum(g in s for s in sets) >= least)
    x = np.array([[g in s for g in names] for s in sets], float)
    up, down = x.T @ y + p.alpha, x.T @ (1 - y) + p.alpha
    r = np.log(up / up.sum()) - np.log(down / down.sum())
    x, r = x[:, np.abs(r) >= p.ratio_floor], r[np.abs(r) >= p.ratio_floor]
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, p.steps + 1):
        g = (1 / (1 + np.exp(-(x @ (r * w[:-1]) + w[-1]))) - y) * share
        g = np.append(r * (x.T @ g) + p.l2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = toxicity.fit(texts, y > 0, p)
    got = [model.weights[model.grams.distinct(t)].sum(dtype=np.float64) + model.bias for t in texts]
    assert np.allclose(got, x @ (r * w[:-1]) + w[-1], atol=1e-2)
