import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.llm import mixing, packing, pii, simhash_dedup
from loomspark.llm.common import table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, rank int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1) for i, t, s in rows], DOCS)


# ---------------------------------------------------------------- personal data


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("write to Anna.Smith@Example.com now", "email"), ("call +49 151 2345 6789 now", "phone"), ("call (212) 555-0187 now", "phone"), ("from 10.1.2.3 to", "ip"), ("card 4111 1111 1111 1111 ok", "card"),
        ("api_key=abcDEF123456789 end", "secret"), ("told Mrs. Elena Petrova that", "name"), ("сказал Иван Петров вчера", "name"),
    ],
)
def test_pii_shape_is_kept(text, kind):
    found = pii.find_entities(text)
    assert [k for *_, k in found] == [kind]
    new, n = pii.replace_entities(text, "k")
    s, e, _ = found[0]
    assert n == 1 and new != text and new[:s] == text[:s] and new.endswith(text[e:])
    assert [k for *_, k in pii.find_entities(new)] == [kind]
    old, fresh = text[s:e], new[s : len(new) - (len(text) - e)]
    if kind in ("phone", "card"):
        assert [c if not c.isdigit() else "9" for c in old] == [c if not c.isdigit() else "9" for c in fresh]
    if kind == "card":
        assert pii.luhn("".join(filter(str.isdigit, fresh)))
    assert pii.replace_entities(text, "other key")[0] != new


def test_pii_distinct_and_coreferent(spark):
    names = [f"Mr. {a}{b}" for a in "BCDFGHJKLMNPRST" for b in ("o", "u", "i", "a", "e")]
    rows = [(i, f"{n} met {names[(i * 7) % len(names)]} at 10.0.0.{i % 250} or {n}.", "s") for i, n in enumerate(names)]
    docs = _docs(spark, rows)
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs).collect()}
    to: dict = {}
    for i, text, _ in rows:
        before, after = [(text[s:e], k) for s, e, k in pii.find_entities(text)], [out[i][s:e] for s, e, _ in pii.find_entities(out[i])]
        assert len(before) == len(after)
        for b, a in zip(before, after):
            assert to.setdefault(b, a) == a
    assert len(set(to.values())) == len(to)
    assert not set(to.values()) & {b for b, _ in to}


@pytest.mark.parametrize(
    ("text", "kinds", "gone"),
    [
        ("mail иван.петров@example.com now", ["email"], ["иван", "петров"]), ("mail josé.núñez@пример.рф now", ["email"], ["josé", "núñez", "пример"]), (f"mail {'a' * 80}.b@x.com now", ["email"], ["a" * 8]), ("mail 张伟@例子.中国 now", ["email"], ["张", "伟"]),
        ("ssn 123-45-6789 ok", ["ssn"], ["123-45-6789"]), ("to DE89 3704 0044 0532 0130 00 please", ["iban"], ["3704 0044"]), ("to GB82WEST12345698765432 please", ["iban"], ["WEST1234"]), ("from 2001:db8::8a2e:370:7334 on", ["ip6"], ["8a2e"]),
        ("she was born on 12/03/1981 there", ["birth"], ["12/03/1981"]), ("DOB: 1981-3-12.", ["birth"], ["1981-3-12"]), ("so Dr Jones said", ["name"], ["Jones"]), ("then Ivanka Trumpova and Boris Pasternak met", ["name", "name"], ["Ivanka", "Trump", "Boris", "Pasternak"]),
        ("with Mr Silva. When Silva left, Ana Silva stayed", ["name", "name", "name"], ["Silva", "Ana"]), ("at 12:30:45, in std::vector, on 12/03/1981", [], []),
    ],
)
def test_pii_nothing_of_it_stays(text, kinds, gone):
    assert [k for *_, k in pii.find_entities(text)] == kinds
    new = pii.replace_entities(text, "k")[0]
    assert not [g for g in gone if g in new]
    if "iban" in kinds:
        assert [k for *_, k in pii.find_entities(new)] == ["iban"]
    if "birth" in kinds:
        assert [k for *_, k in pii.find_entities(new)] == ["birth"]


def test_pii_surnames_are_coreferent_and_scripts_kept():
    new = pii.replace_entities("with Mr Silva. When Silva left, Ana Silva and Petra Silva stayed", "k")[0]
    a, b, c, d = (new[s:e].split() for s, e, _ in pii.find_entities(new))
    assert a[1] == b[0] == c[1] == d[1] and c[0] != d[0] and {c[0], d[0]} <= set(pii.GIVEN["latin", "f"])
    local, domain = pii.surrogate("email", "иван@пример.рф", "k").split("@")
    assert len(local) == 4 and all("а" <= ch <= "я" for ch in local + domain.replace(".", ""))
    assert pii.surrogate("surname", "Петрова", "k").endswith("ова")


def test_pii_no_value_of_the_corpus_survives(spark):
    """Brute force over the documents: no value that is detected anywhere is found in any text afterwards, equal values
    have equal surrogates and different ones different ones."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs).collect()}
    values = lambda texts: {(k, pii.canonical(t[s:e], k)) for t in texts.values() for s, e, k in pii.find_entities(t)}
    old = values(before)
    assert len(old) > 50 and not old & values(after)
    to: dict = {}
    for i, text in before.items():
        one, two = pii.find_entities(text), pii.find_entities(after[i])
        assert len(one) == len(two)
        if not one:
            assert after[i] == text
        for (s, e, k), (s2, e2, k2) in zip(one, two):
            assert k == k2 and to.setdefault((k, pii.canonical(text[s:e], k)), pii.canonical(after[i][s2:e2], k)) == pii.canonical(after[i][s2:e2], k)
    assert len({(k, v) for (k, _), v in to.items()}) == len(to)


def test_pii_keeps_columns_of_any_name(spark):
    rows = [(1, "Mr. James met Mr. Robert", "a", "b", "c", 4)] + [(i, f"Mr. {n}", "a", "b", "c", 4) for i, n in enumerate(pii.GIVEN["latin", "m"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _tag string, _as string, `a.b` string, n int")
    got = pii.pseudonymize(docs).collect()
    assert len(got) == len(rows) and all(tuple(r)[2:] == ("a", "b", "c", 4) for r in got)


def test_pii_edges(spark):
    docs = _docs(spark, [(None, "a@b.com", "s"), (1, None, "s"), (2, "", None), (3, "x a@b.com " * 20_000, "s"), (3, "x a@b.com " * 20_000, "s"), (4, "nothing here", "s")])
    got = pii.pseudonymize(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and by[1]["text"] is None and by[2]["text"] == "" and by[4]["text"] == "nothing here"
    assert "a@b.com" not in by[3]["text"] and by[None]["text"] in by[3]["text"]
    assert pii.pseudonymize(_docs(spark, [])).count() == 0


def test_pii_pool_of_given_names_runs_out(spark):
    titled = [("Mr.", ("latin", "m")), ("Mrs.", ("latin", "f")), ("господин", ("cyrillic", "m")), ("κυρία", ("greek", "f"))]
    names = [f"{t} {n}" for t, pool in titled for n in pii.GIVEN[pool]]
    docs = _docs(spark, [(i, f"we saw {n} there, {n} again", "s") for i, n in enumerate(names)])
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs).collect()}
    new = []
    for i in range(len(names)):
        two = [got[i][s:e] for s, e, k in pii.find_entities(got[i]) if k == "name"]
        assert len(two) == 2 and two[0] == two[1] and two[0].split()[0] == names[i].split()[0]
        new.append(pii.canonical(two[0], "name"))
    assert len(set(new)) == len(new) and not set(new) & {n.split()[1] for n in names}
    with pytest.raises(RuntimeError):
        pii.pseudonymize(docs, pii.PiiParams(attempts=0)).count()


def test_pii_widened_ranges():
    some = [f"192.168.{a}.{b}" for a in range(0, 256, 16) for b in range(0, 256, 8)] + [f"10.0.{a}.1" for a in range(99)] + ["172.16.0.0", "172.31.255.255"]
    new = [pii.surrogate("ip", v, "k", pii.WIDEN_AFTER + 1) for v in some]
    assert len(set(new)) == len(some) and all(v.startswith("10.") or v.startswith("192.168.") or 16 <= int(v.split(".")[1]) < 32 and v.startswith("172.") for v in new)
    assert sum(v.startswith("192.168.") for v in new) < len(new) / 10
    for kind, value in (("phone", "+12125550187"), ("phone", "2125550187"), ("card", "4111111111111111")):
        got = {pii.surrogate(kind, value, "k", pii.WIDEN_AFTER + n)[:3] for n in range(1, 9)}
        assert len(got) > 4 and all(len(pii.surrogate(kind, value, "k", n)) == len(value) for n in range(9))
    assert pii.luhn(pii.surrogate("card", "4111111111111111", "k", pii.WIDEN_AFTER + 2))


def test_permutation_is_one():
    for size in (1, 2, 5, 10, 97, 1000):
        assert sorted(pii.permute(b"k", "t", x, size) for x in range(size)) == list(range(size))


# ---------------------------------------------------------------- near duplicates


def _components(prints, radius):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b:
                d = sum(((prints[a][k] ^ prints[b][k]) & (2**64 - 1)).bit_count() for k in (0, 1))
                if d <= radius or prints[a][2] == prints[b][2]:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_groups_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for c in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(c and rng.randrange(0, 9)):
                words[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((i, " ".join(words), "s"))
            i += 1
    prints = {i: simhash_dedup.fingerprint(t) for i, t, _ in rows}
    want = _components(prints, simhash_dedup.SimHashParams().radius)
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.groups(_docs(spark, rows)).collect()}
    pairs = lambda g: {(a, b) for a in g for b in g if a < b and g[a] == g[b]}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.95 * len(pairs(want)) > 50


def test_simhash_recall_by_distance():
    rng = np.random.default_rng(12)
    params = simhash_dedup.SimHashParams()
    bits = rng.integers(0, 2, (600, simhash_dedup.BITS), dtype=np.uint8)
    for d in (8, 16, 19, 21, 22):
        other = bits.copy()
        for row in other:
            row[rng.permutation(simhash_dedup.BITS)[:d]] ^= 1
        met = np.zeros(len(bits), bool)
        for at in params.positions():
            met |= (bits[:, at] == other[:, at]).all(1)
        assert met.mean() >= 0.92, d


@pytest.mark.parametrize("n", [1000, 250_000, 15_000_000, 50_000_000_000])
def test_simhash_recall_at_the_radius_at_every_size(n):
    """Pairs at each distance up to the radius, against the recall that is wanted, with the keys chosen for n fingerprints."""
    params = simhash_dedup.SimHashParams().fitted(n)
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2, (400, simhash_dedup.BITS), dtype=np.uint8)
    for d in (4, 16, 18, 20, 22):
        other = bits.copy()
        for row in other:
            row[rng.permutation(simhash_dedup.BITS)[:d]] ^= 1
        met = np.zeros(len(bits), bool)
        for a, b in zip(simhash_dedup.keys(bits, params), simhash_dedup.keys(other, params)):
            met |= a == b
        assert met.mean() >= 0.91, (n, d)


def test_simhash_hot_shards_are_divided(spark):
    """A third of the rows are near copies of one text, each with a fingerprint of its own, and shards of over 40 are hot."""
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(w if rng.random() > 0.04 else rng.choice(vocabulary) for w in base) for _ in range(150)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    params = simhash_dedup.SimHashParams(hot_rows=40, hot_sample=450)
    prints = {i: simhash_dedup.fingerprint(t) for i, t, _ in rows}
    table_ = spark.createDataFrame([(i, p[0], p[1]) for i, p in prints.items()], "id bigint, high bigint, low bigint")
    assert simhash_dedup._hot(table_, 450, params.fitted(450))
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.groups(_docs(spark, rows), params).collect()}
    want = _components(prints, params.radius)
    assert sum(got[i] == 0 for i in range(150)) >= 0.97 * sum(want[i] == 0 for i in range(150)) > 100
    assert all(got[i] == i for i in range(150, 450) if want[i] == i)


def _at_the_radius(n, seed):
    """n fingerprints and one at a distance of 19 to 22 for each of them: (id, high, low), partners having ids from n on."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, simhash_dedup.BITS), dtype=np.uint8)
    other = bits.copy()
    for k, row in enumerate(other):
        row[rng.permutation(simhash_dedup.BITS)[: 22 - k % 4]] ^= 1
    halves = np.packbits(np.concatenate([bits, other]), axis=1).view(np.int64)
    return [(i, int(a), int(b)) for i, (a, b) in enumerate(halves)]


@pytest.mark.parametrize("radius", [0, 1, 3, 22, 30])
def test_simhash_search_finds_every_pair_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    prints = np.array([p[1:] for p in _at_the_radius(150, radius)]).view(np.uint64)
    prints[100:150] = prints[99] ^ (np.uint64(1) << rng.integers(0, 64, (50, 2), dtype=np.uint64))  # many near one another
    want = simhash_dedup.Links(300)
    for i in range(300):
        near = np.flatnonzero(simhash_dedup.distance(prints[i], prints) <= radius)
        want.add(np.full(len(near), i), near)
    for k in (None, 4, 7, 16):
        for hot in (1, 1 << 22):
            got, at = simhash_dedup.Links(300), np.arange(300)
            search = simhash_dedup.Near(prints, radius, got)
            search.HOT = hot
            for a, b in ((at[:130], at[:130]), (at[:130], at[130:]), (at[130:], at[130:])):
                search.search(a, b, k)
            assert (got.settle() == want.settle()).all(), (radius, k, hot)


def test_simhash_links_do_not_depend_on_the_size(spark, monkeypatch):
    """All pairs near the radius are found, alone and among 90,000 others, whatever the blocks."""
    some = _at_the_radius(200, 1)
    rng = np.random.default_rng(2)
    more = [(1000 + i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(-(2**63), 2**63 - 1, (90_000, 2)))]
    for rows, params in ((some, simhash_dedup.SimHashParams()), (some, simhash_dedup.SimHashParams(block_rows=60)), (some + more, simhash_dedup.SimHashParams())):
        prints = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "high", "low"]))
        monkeypatch.setattr(simhash_dedup, "_fingerprints", lambda docs, prints=prints: prints)
        got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.groups(prints.select("doc_id"), params).collect()}
        assert len(got) == len(rows) and all(got[i] == got[200 + i] == i for i in range(200)), params


def test_pipeline_drops_the_same_copies_at_any_size(spark, monkeypatch):
    """The stage keeps one of each planted pair near the radius, alone and among 30,000 other documents."""
    import corpus_pipeline

    some = _at_the_radius(100, 3)
    more = [(1000 + i, int(a), int(b)) for i, (a, b) in enumerate(np.random.default_rng(4).integers(-(2**63), 2**63 - 1, (30_000, 2)))]
    for rows in (some, some + more):
        docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "high", "low"])).withColumn("text", F.lit("t"))
        monkeypatch.setattr(simhash_dedup, "_fingerprints", lambda docs: docs.select("doc_id", "high", "low"))
        kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
        assert kept == {i for i, *_ in rows} - set(range(100, 200))


def test_pipeline_keeps_the_same_of_rows_alike_in_text(spark):
    """Repeated rows with one text and other columns of their own: the same one stays, whatever the parts of the table and the join."""
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i * 50 + k}" for k in range(40)), "en", f"src{(i + s) % 5}", s, {"at": s}) for s in range(5) for i in range(60)]
    got = []
    for seed, parts, most in ((0, 1, "10m"), (1, 8, "10m"), (2, 3, "-1")):
        docs = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` map<string, int>").repartition(parts)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        got.append(sorted(tuple(r)[:5] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[0] == got[1] == got[2] and len(got[0]) > 50 and {r[3] for r in got[0]} == {"src0"}
    maps = spark.createDataFrame([(1, "same words", {"k": v}) for v in (3, 1, 2)], "doc_id bigint, text string, m map<string, int>")
    assert [[r["m"] for r in simhash_dedup.deduplicate(maps.repartition(n)).collect()] for n in (1, 3)] == [[{"k": 1}]] * 2


def test_simhash_sampled_on_request(spark):
    rng = random.Random(32)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = [" ".join(w if rng.random() > 0.03 else f"w{rng.randrange(4000)}" for w in base) for _ in range(60)] + [" ".join(f"w{rng.randrange(4000)}" for _ in range(150)) for _ in range(200)]
    docs = _docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    exact, sampled = ({r["doc_id"]: r["group_id"] for r in simhash_dedup.groups(docs, simhash_dedup.SimHashParams(hot_rows=40, hot_sample=260, sampled=x)).collect()} for x in (False, True))
    assert sum(g == 0 for g in exact.values()) >= 55 and sum(g == 0 for g in sampled.values()) >= 0.97 * sum(g == 0 for g in exact.values())


def test_simhash_deduplicate_on_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some words that are alike", 5, "x"), (2, "some words that are alike", 6, "y"), (2, None, 7, None), (3, None, 8, "z")], "doc_id bigint, text string, _kept_id int, _row_of_id string")
    got = sorted(simhash_dedup.deduplicate(docs).collect())
    assert [r["doc_id"] for r in got] == [1, 3] and got[0]["_kept_id"] == 5 and got[1]["_row_of_id"] == "z"
    mixed = mixing.mix(docs.withColumn("source", docs["_row_of_id"]).withColumn("_mix_shard", docs["doc_id"])).collect()
    assert len(mixed) == 4 and sorted(r["_mix_shard"] for r in mixed) == [1, 2, 2, 3]


def test_bk_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, (300, 2), dtype=np.int64).view(np.uint64)
    for k in range(0, 280, 3):
        prints[k + 1] = prints[k] ^ np.uint64(rng.integers(0, 2**12))
    key = np.repeat([1, 2, 5], 100)
    forest = simhash_dedup.BKForest(key, prints)
    q, n = forest.search(np.arange(300), 20)
    want = {(a, b) for a in range(300) for b in range(300) if key[a] == key[b] and simhash_dedup.distance(prints[a], prints[b]) <= 20}
    assert set(zip(q.tolist(), n.tolist())) == want and len(q) == len(want)


def test_simhash_edges(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, "same words here", "a"), (2, "Same words, here!", "b"), (2, "Same words, here!", "b"), (3, None, "a"), (4, "", "a"), (5, "...", "a"), (None, "same words here", "a"), (6, long, "a"), (7, long, None)]
    docs = _docs(spark, rows)
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    kept = simhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert simhash_dedup.deduplicate(_docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (None, 3), (500, 400)], "a bigint, b bigint")
    got = {r["id"]: r["group"] for r in simhash_dedup.components(edges).collect()}
    assert {got.get(i, i) for i in range(201)} == {0} and got[500] == 400


# ---------------------------------------------------------------- mixing


def test_mixing_keeps_exact_quotas(spark):
    rng = random.Random(1)
    rows = [(i, "t", rng.choice(["a", "a", "a", "b", "c"])) for i in range(3000)]
    params = mixing.MixingParams(weights=(("a", 0.5), ("b", 0.3), ("c", 0.2)), block_rows=4, shard_blocks=16)
    got = mixing.assign(_docs(spark, rows), params).collect()
    of = {i: s for i, _, s in rows}
    have = Counter(of.values())
    want = mixing.quotas({s: -(-n // 4) for s, n in have.items()}, dict(params.weights))
    blocks = defaultdict(set)
    for r in got:
        assert of[r["doc_id"]] == r["source"]
        blocks[r["source"]].add(r["block"])
    assert {s: len(b) for s, b in blocks.items()} == want
    assert len({r["doc_id"] for r in got}) == len(got)
    assert len({(r["source"], r["block"], r["shard"]) for r in got}) == sum(want.values())
    per = Counter(r["shard"] for r in got)
    assert all(sorted(r["position"] for r in got if r["shard"] == s) == list(range(n)) for s, n in per.items())
    total = sum(want.values())
    assert max(abs(want[s] / total - w) for s, w in params.weights) < 0.01


def test_splitting_tree_adds_up():
    counts = np.array([37, 5, 0, 120])
    parts = [mixing.leaf(counts, 11, k, 9) for k in range(11)]
    assert (sum(p[1] for p in parts) == counts).all()
    assert [int(p[1].sum()) for p in parts] == [mixing.shard_sizes(162, k, k + 1, 11) for k in range(11)]
    for a, b in zip(parts, parts[1:]):
        assert (a[0] + a[1] == b[0]).all()


def test_split_is_hypergeometric():
    rng = np.random.default_rng(0)
    draws = np.array([mixing.split(np.array([30, 10]), 20, rng) for _ in range(4000)])
    assert (draws.sum(1) == 20).all() and abs(draws[:, 0].mean() - 15) < 0.15 and abs(draws[:, 0].var() - 20 * 0.75 * 0.25 * 20 / 39) < 0.25


def test_draw_of_more_than_a_thousand_million():
    rng = np.random.default_rng(3)
    good, bad, many = 2_000_000_000, 3_000_000_000, 1_250_000_000
    draws = np.array([mixing.draw(good, bad, many, rng) for _ in range(300)], float)
    spread = np.sqrt(many * 0.4 * 0.6 * 0.75)
    assert abs(draws.mean() - many * 0.4) < 4 * spread / np.sqrt(300) and 0.85 < draws.std() / spread < 1.15
    assert mixing.draw(2_000_000_000, 5, 2_000_000_005, rng) == 2_000_000_000 and mixing.draw(5, 2_000_000_000, 2_000_000_005, rng) == 5
    first, counts = mixing.leaf(np.array([2_500_000_000, 1_500_000_000, 7]), 1 << 24, 12_345_678, 1)
    assert counts.sum() == mixing.shard_sizes(4_000_000_007, 12_345_678, 12_345_679, 1 << 24) and (first >= 0).all()


def test_wide_draw_keeps_the_tail_of_a_rare_source():
    """Of a million blocks among 1e12, 1e4 draws take 4 or more with a chance of 4e-10, more than 4 with 8e-13."""

    class Late:
        def random(self):
            return 1 - 1e-12

    assert mixing.draw(10**6, 10**12, 10**4, Late()) == 4


def test_wide_draw_is_the_same_distribution():
    """The sum over the distribution against the exact one, by fractions of binomials."""
    from math import comb

    good, bad, many = 9, 14, 8
    exact = np.array([comb(good, x) * comb(bad, many - x) / comb(good + bad, many) for x in range(many + 1)])
    x = np.arange(0, many, dtype=float)
    logs = np.r_[0, np.cumsum(np.log(good - x) + np.log(many - x) - np.log(x + 1) - np.log(bad - many + x + 1))]
    assert np.allclose(np.exp(logs) / np.exp(logs).sum(), exact)


def test_mixing_at_given_targets_against_brute_force(spark):
    """Quotas by fractions: the largest total that no source falls short of, rounded by largest remainders."""
    from fractions import Fraction

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").distinct().collect()}
    weights, size = {s: Fraction(w) for s, w in mixing.TARGETS.weights}, mixing.TARGETS.block_rows
    have = {s: -(-n // size) for s, n in Counter(rows.values()).items()}
    whole = sum(weights[s] for s in have)
    total = min(have[s] * whole / weights[s] for s in have)
    exact = {s: total * weights[s] / whole for s in have}
    want = {s: int(x) for s, x in exact.items()}
    for s in sorted(have, key=lambda s: (-(exact[s] - want[s]), s))[: int(total) - sum(want.values())]:
        want[s] += 1
    got = mixing.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    blocks = defaultdict(set)
    for r in got:
        assert rows[r["doc_id"]] == r["source"]
        blocks[r["source"]].add(r["block"])
    assert {s: len(b) for s, b in blocks.items()} == want and len({r["doc_id"] for r in got}) == len(got)


def test_mixing_isnt_shrunk_by_a_tiny_source(spark):
    rows = [(i, "t", "big") for i in range(4000)] + [(9000 + i, "t", "tiny") for i in range(16)] + [(None, "t", "big")]
    docs = _docs(spark, rows)
    assert {tuple(r) for r in mixing.report(docs).collect()} == {("big", 4000, 4000), ("tiny", 16, 16)}
    assert sorted(r["doc_id"] or 0 for r in mixing.mix(docs).collect()) == sorted(r[0] or 0 for r in rows)
    some = {r["source"]: r["rows_out"] for r in mixing.report(docs, mixing.MixingParams(total=100)).collect()}
    assert sum(some.values()) == 1600 and some["tiny"] == 16
    assert mixing.quotas({"a": 62500, "b": 1}, {"a": 0.5, "b": 0.5}, 1000) == {"a": 999, "b": 1}
    assert mixing.quotas({"a": 62500, "b": 1}, {"a": 0.5, "b": 0.5}) == {"a": 1, "b": 1}


def test_mixing_edges(spark):
    docs = _docs(spark, [(None, "t", "a"), (1, "t", None), (1, "t", None), (2, None, "b"), (3, "", "b")])
    got = mixing.assign(docs, mixing.MixingParams(block_rows=1)).collect()
    assert {(r["doc_id"], r["source"]) for r in got} <= {(1, ""), (2, "b"), (3, "b")} and len(got) >= 2
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.assign(_docs(spark, [])).count() == 0 and mixing.mix(_docs(spark, [])).count() == 0


# ---------------------------------------------------------------- packing

EXAMPLES = "id bigint, tokens bigint, segments bigint, loss_tokens bigint, pack_id string"


def _greedy(demand, limits):
    """The same rule, spelled out: for each place the fitting example of the largest dot product with the room left."""
    need = [[x / m for x, m in zip(d, limits)] for d in demand]
    weight = [sum(n[k] for n in need) / len(need) for k in range(len(limits))]
    order = sorted(range(len(need)), key=lambda i: -sum(a * w for a, w in zip(need[i], weight)))
    bins, left = [], list(order)
    while left:
        room, own = [1.0] * len(limits), []
        while True:
            fits = [i for i in left if all(a <= r + 1e-9 for a, r in zip(need[i], room))]
            if not fits:
                break
            best = max(fits, key=lambda i: round(sum(a * w * r for a, w, r in zip(need[i], weight, room)), 12))
            own.append(best)
            left.remove(best)
            room = [r - a for r, a in zip(room, need[best])]
        bins.append(own)
    return bins


def test_packing_follows_the_heuristic():
    rng = random.Random(4)
    demand = np.array([[rng.randint(1, 4000), rng.randint(1, 20), rng.randint(0, 2500)] for _ in range(200)], float)
    limits = np.array([4096.0, 64.0, 3072.0])
    bins, place = packing.pack_group(demand, limits)
    want = _greedy(demand.tolist(), limits.tolist())
    assert len(want) == bins.max() + 1
    assert [[int(i) for i in sorted(np.flatnonzero(bins == b), key=lambda i: place[i])] for b in range(len(want))] == want


def test_packing_limits_and_edges(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 5000), rng.randint(1, 80), rng.randint(0, 4000), "x") for i in range(500)] + [(None, 5, 1, 1, "x"), (7, None, None, None, "x"), (8, 100_000, 3, 9_000, "x"), (8, 100_000, 3, 9_000, "x")]
    params = packing.PackingParams(group_rows=100)
    got = packing.pack(spark.createDataFrame(rows, EXAMPLES), params).collect()
    use = defaultdict(lambda: np.zeros(3, int))
    total = Counter()
    for r in got:
        use[r["pack_id"]] += (r["tokens"], r["segments"], r["loss_tokens"])
        total[r["id"]] += r["tokens"]
    assert all((u <= (params.tokens, params.segments, params.loss_tokens)).all() for u in use.values())
    want = Counter()
    for i, n, *_ in rows:
        want[i] += n or 0
    assert total == want
    assert len({(r["pack_id"], r["position"]) for r in got}) == len(got)
    assert packing.pack(spark.createDataFrame([], EXAMPLES)).count() == 0


def test_pieces_follow_the_turns(spark):
    """Brute force: mark every token of an example by its turn and by whether it bears loss, and count in each piece."""
    rng = random.Random(21)
    params = packing.PackingParams(tokens=100, segments=7, loss_tokens=40, group_rows=64)
    rows, marks = [], {}
    for i in range(120):
        layout = [(n, rng.choice([0, n, n // 2])) for n in (rng.choice([0, 1, 5, 30, 150]) for _ in range(rng.randint(1, 12)))]
        marks[i] = [(k, j >= n - b) for k, (n, b) in enumerate(layout) for j in range(n)]
        rows.append((i, sum(n for n, _ in layout), len(layout), sum(b for _, b in layout), layout))
    rows.append((0, 5000, 2, 2500, [(2500, 0), (2500, 2500)]))
    rows[-1] = (500, *rows[-1][1:])
    marks[500] = [(0, False)] * 2500 + [(1, True)] * 2500
    got = packing.pack(spark.createDataFrame(rows, "id bigint, tokens bigint, segments bigint, loss_tokens bigint, layout array<struct<tokens: bigint, loss_tokens: bigint>>"), params).collect()
    by, use = defaultdict(list), defaultdict(lambda: np.zeros(3, int))
    for r in got:
        by[r["id"]].append(r)
        use[r["pack_id"]] += (r["tokens"], r["segments"], r["loss_tokens"])
    assert all((u <= (100, 7, 40)).all() for u in use.values())
    for i, mark in marks.items():
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(parts[0]["pieces"]))
        at = 0
        for r in parts:
            own = mark[r["start"] : r["start"] + r["tokens"]]
            assert r["start"] == at and sum(loss for _, loss in own) == r["loss_tokens"] and len({k for k, _ in own}) <= r["segments"]
            at += r["tokens"]
        assert at == len(mark)


def test_packing_counts_whole_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello there", 1), (1, 1, "assistant", "word " * 9000, 1), (2, 0, "user", None, 1), (None, 0, "assistant", "", 1)], "conv_id bigint, turn bigint, role string, text string, tokens int")
    by = {r["id"]: r for r in packing.conversation_examples(turns).collect()}
    assert by[1]["segments"] == 2 and by[1]["loss_tokens"] >= 9000 and by[1]["tokens"] > by[1]["loss_tokens"] and by[2]["tokens"] == 0 and by[None]["segments"] == 1


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "pii", "mixing", "packing"]
    docs = table(spark, small, "documents")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, small)
        after.write.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        after = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        if k < 4:
            assert after.columns == columns
            assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            docs = after
        seen[name] = after.count()
    assert after.select("doc_id").distinct().exceptAll(docs.select("doc_id")).count() == 0 and after.select("doc_id").distinct().count() == seen["mixing"]
    toxic = table(spark, small, "labels").where("toxic > 0").select("doc_id")
    before = table(spark, small, "documents").join(toxic, "doc_id", "left_semi").count()
    assert docs.join(toxic, "doc_id", "left_semi").count() <= 0.2 * before  # labels are noisy, and few here
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert corpus_pipeline.run(spark, small).count() == seen["packing"]


def test_pipeline_stages_on_odd_rows(spark, small):
    """Nulls in every column, an empty and a very long text, repeated rows and ids, ties, and an extra column."""
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [
        (1, "The very same text about rivers and bridges in winter.", "en", "a", 54), (2, "The very same text about rivers and bridges in winter.", "en", "b", 54), (3, None, "en", "a", None), (4, "", None, None, 0), (5, long, "en", "a", len(long)), (6, long + " end", "en", "a", None),
        (None, "No id at all, but some words.", "de", "b", 1), (None, None, None, None, None), (7, "Write to mr.x@example.com or call (212) 555-0187.", "fr", None, 1), (7, "Write to mr.x@example.com or call (212) 555-0187.", "fr", None, 1), (8, "...", "es", "c", 3),
    ]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, _group int")
    ids = lambda df: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.collect())
    left = {"toxicity": [-1, -1, 1, 2, 3, 4, 5, 6, 7, 7, 8]} | dict.fromkeys(("simhash_dedup", "pii", "mixing"), [-1, -1, 1, 3, 4, 5, 7, 8])
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, small), "odd")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_group"] and ids(docs) == left[name], name
    by = {r["doc_id"]: r for r in docs.where("doc_id IS NOT NULL").collect()}
    assert by[3]["text"] is None and by[3]["n_chars"] is None and by[4]["text"] == "" and by[5]["text"] == long and "example.com" not in by[7]["text"]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == {None, 1, 3, 4, 5, 7, 8} and sum(r["doc_id"] is None for r in packed) == 2 and sum(r["doc_id"] == 5 for r in packed) > 10


def test_pipeline_and_queries_on_an_empty_corpus(spark, small):
    import corpus_pipeline

    docs = table(spark, small, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
