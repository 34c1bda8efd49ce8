"""Keyword and vector search for batches of queries, fusion of their legs, and what is done to the candidates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomspark.functions import text as T

from .shared import NUMBERS, Holders, TopK, id_array, in_blocks, runs_within, spread, written

#: Places that scores carry: enough to tell any two apart but for the noise of sums taken in another order, so that equal
#: texts tie, and ties go by id.
PLACES = 9
#: Bound of the text or of the numbers of a block of queries, of which a task holds one.
BLOCK_BYTES = 32 << 20
TECHNIQUES = ("arithmetic_mean", "geometric_mean", "harmonic_mean", "reciprocal_rank_fusion")


def in_scope(chunks: DataFrame, set_ids: list[str] | None = None, owner: str | None = None) -> DataFrame:
    """Enabled chunks of the sets (all, if None) and, if given, of the owner."""
    out = chunks.where(F.coalesce(F.col("enabled"), F.lit(True)))
    if set_ids is not None:
        out = out.where(F.col("set_id").isin(set_ids))
    return out if owner is None else out.where(F.col("owner") == owner)


def _top(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _hits(best: TopK, ids: list, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    q, chunk, score = best.rows()
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], kinds[0]), pa.array(chunk.tolist(), kinds[1]), pa.array(score)], ["query_id", "chunk_id", "score"])


def _hit_schema(chunks: DataFrame, queries: DataFrame) -> tuple[str, tuple[pa.DataType, pa.DataType]]:
    q, c = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    return f"query_id {q.simpleString()}, chunk_id {c.simpleString()}, score double", (to_arrow_type(q), to_arrow_type(c))


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank) of chunks (chunk_id, text) for queries (query_id, text).

    Texts are read and cut into terms once: what is written of a chunk is its length and the counts of those of its terms
    that a query has. From these come the statistics, one row a term, and then the scores, without a shuffle by term, of
    which each task passes on its k best for each query. Queries are held by every task, in blocks of block_bytes of text.
    Repeated terms of a query count once. Ties go by chunk_id."""
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    return reduce(DataFrame.unionByName, [_bm25_block(chunks, part, k, k1, b) for part in in_blocks(asked, F.octet_length("text"), block_bytes)])


def _flat(terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy().astype(np.int64)


def _bm25_scores(whole: pa.RecordBatch, holders: Holders, idf: np.ndarray, mean: float, k1: float, b: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch in parts, each with its scores (queries x rows). A term makes a number for each query that has it, so parts
    go by those numbers: rows of terms that all queries share make hundreds of times their own size."""
    for start, end in runs_within(holders.numbers(*_flat(whole.column(2)), whole.num_rows), NUMBERS):
        batch = whole.slice(start, end - start)
        (row, term), size = _flat(batch.column(2)), batch.column(1).to_numpy()
        tf = batch.column(3).flatten().to_numpy().astype(np.float64)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean)) if len(term) else tf
        score = np.round(holders.spread(row, term, weight, batch.num_rows), PLACES)
        yield batch, np.where(score > 0, score, -np.inf)


def _bm25_block(chunks: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    spark = chunks.sparkSession
    rows = asked.collect()  # a block
    ids, holders = [r["query_id"] for r in rows], Holders([T.term_list(r["text"]) for r in rows])
    schema, kinds = _hit_schema(chunks, asked)
    wanted = spark.sparkContext.broadcast(holders.place)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = wanted.value
        for batch in batches:
            size, term, many = [], [], []
            for text in batch.column(1).to_pylist():
                found = T.term_list(text)
                own = sorted((place[t], n) for t, n in Counter(found).items() if t in place)
                size.append(len(found))
                term.append([t for t, _ in own])
                many.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(many, pa.list_(pa.int32()))], ["chunk_id", "size", "terms", "counts"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    postings = written(spread(chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(counted, f"chunk_id {kind}, size bigint, terms array<int>, counts array<int>"), "postings")
    n, mean = postings.agg(F.count("*"), F.avg("size")).first()
    df = np.zeros(max(len(holders.place), 1))
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[r["t"]] = r["count"]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    held = spark.sparkContext.broadcast((holders, idf))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, idf = held.value
        best = TopK(holders.n, k)
        for whole in batches if holders.n else ():
            for batch, score in _bm25_scores(whole, holders, idf, mean, k1, b):
                best.add(id_array(batch.column(0)), score)
        yield _hits(best, ids, kinds)

    return _top(postings.mapInArrow(scored, schema), k)


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact, score = (1 + cosine) / 2, so never negative. A vector that is null, empty,
    of norm 0 or of another length than the query's has cosine 0.

    Every task holds the queries, in blocks of block_bytes, multiplies its vectors with them and passes on the k best for
    each query. Ties go by chunk_id."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    return reduce(DataFrame.unionByName, [_knn_block(vectors, part, k) for part in in_blocks(asked, F.size("vector") * 8, block_bytes)])


def _unit(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (places, unit vectors) of the rows that have a norm."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        if v is not None and len(v):
            by.setdefault(len(v), []).append(i)
    out = {}
    for size, at in by.items():
        x = np.array([rows[i] for i in at], np.float64)
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        out[size] = (np.array(at)[good], x[good] / norm[good][:, None])
    return out


def _knn_block(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.collect()  # a block
    ids, many = [r["query_id"] for r in rows], len(rows)
    schema, kinds = _hit_schema(vectors, asked)
    held = vectors.sparkSession.sparkContext.broadcast(_unit([r["vector"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = TopK(many, k), max(1, NUMBERS // max(many, 1))
        for whole in batches:
            for at in range(0, whole.num_rows if many else 0, step):
                batch = whole.slice(at, step)
                cosine = np.zeros((many, batch.num_rows))
                for size, (place, x) in _unit(batch.column(1).to_pylist()).items():
                    if size in held.value:
                        q, y = held.value[size]
                        cosine[np.ix_(q, place)] = y @ x.T
                best.add(id_array(batch.column(0)), np.round((1 + cosine) / 2, PLACES))
        yield _hits(best, ids, kinds)

    return _top(vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema), k)


def bm25_rank(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the wanted (query_id, chunk_id) among the hits; nulls where it isn't there."""
    return wanted.select("query_id", "chunk_id").join(hits.select("query_id", "chunk_id", "score", "rank"), ["query_id", "chunk_id"], "left")


def hybrid_scores(keyword_leg: DataFrame, vector_leg: DataFrame, weights: tuple[float, float] = (0.5, 0.5), technique: str = "arithmetic_mean") -> DataFrame:
    """What a store's own hybrid query gives: (query_id, chunk_id, score, rank). The legs come as keyword, vector, and so
    do the weights. Each leg is scaled by its own hits, a missing one counts 0, and means are weighted; the geometric and
    the harmonic one leave out legs that score 0. Reciprocal ranks (constant 60) take no weights."""
    legs = []
    for leg, w in zip((keyword_leg, vector_leg), weights):
        own = Window.partitionBy("query_id")
        low, high = F.min("score").over(own), F.max("score").over(own)
        scaled = F.when(high == low, 1.0).otherwise(F.try_divide(F.col("score") - low, high - low))
        legs.append(leg.select("query_id", "chunk_id", F.greatest(scaled, F.lit(0.001)).alias("x"), (1 / (60 + F.col("rank"))).alias("r"), F.lit(max(float(w), 1e-6)).alias("w")))
    both = legs[0].unionByName(legs[1]).groupBy("query_id", "chunk_id")
    whole = sum(max(float(w), 1e-6) for w in weights)
    how = {
        "arithmetic_mean": F.sum(F.col("w") * F.col("x")) / whole,
        "geometric_mean": F.exp(F.sum(F.col("w") * F.log("x")) / F.sum("w")),
        "harmonic_mean": F.sum("w") / F.sum(F.col("w") / F.col("x")),
        "reciprocal_rank_fusion": F.sum("r"),
    }
    return both.agg(F.round(how[technique], PLACES).alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def ids_in_set(chunks: DataFrame, set_ids: list[str]) -> DataFrame:
    """(chunk_id): the distinct ids of the sets, however many."""
    return chunks.where(F.col("set_id").isin(set_ids)).select("chunk_id").distinct()


def chunk_vector(chunks: DataFrame, chunk_id, model: str) -> DataFrame:
    """(chunk_id, vector) of one chunk by a model, from the map vectors (model to vector); null where it has none."""
    return chunks.where(F.col("chunk_id") == chunk_id).select("chunk_id", F.try_element_at("vectors", F.lit(model)).alias("vector"))


def combined(technique: str, a: Column, b: Column) -> Column:
    if technique == "geometric_mean":
        return F.sqrt(a * b)
    if technique == "harmonic_mean":
        return F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0))
    return (a + b) / 2


def fuse(vector_leg: DataFrame, keyword_leg: DataFrame, technique: str = "arithmetic_mean", keyword_weight: float = 0.3, top_k: int = 20) -> DataFrame:
    """(query_id, chunk_id, vector_score, vector_rank, bm25_score, bm25_rank, fused, fused_rank) over the union of both
    legs (query_id, chunk_id, score, rank). A missing score counts as 0 before min-max; a constant leg becomes 1."""
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown fusion technique {technique}")
    kw = min(max(keyword_weight, 0.0), 1.0)
    v = vector_leg.select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    t = keyword_leg.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    both = v.join(t, ["query_id", "chunk_id"], "full_outer")
    if technique == "reciprocal_rank_fusion":
        part = lambda c: 60 + F.coalesce(F.col(c), F.lit(2 * top_k))
        fused = (1 - kw) / part("vector_rank") + kw / part("bm25_rank")
    else:
        every = Window.partitionBy("query_id")

        def scaled(c: str) -> Column:
            x = F.coalesce(F.col(c), F.lit(0.0))
            low, high = F.min(x).over(every), F.max(x).over(every)
            return F.when(high == low, 1.0).otherwise(F.try_divide(x - low, high - low))

        fused = combined(technique, scaled("vector_score") * (1 - kw) * 2, scaled("bm25_score") * kw * 2)
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    return both.withColumn("fused", F.round(fused, PLACES)).withColumn("fused_rank", F.row_number().over(order))


def _by_query(rows: DataFrame) -> DataFrame:
    """Rows dealt by query to as many tasks as shuffles have: what is done with a query costs far more than its bytes, by
    which small shuffles would be drawn together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")


def drop_near_duplicates(candidates: DataFrame, radius: int = 3, contained: float | None = None) -> DataFrame:
    """Candidates (query_id, fused_rank, chunk_text, ...) without those whose SimHash is within radius of a better one
    that stays, or (if contained is given) whose words are in one by that share; final_rank counts what stays. An empty
    text always stays. Greedy by rank, for each query on its own few candidates."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fused_rank", kind="stable")
        hashes: list[int] = []
        sets: list[set[str]] = []
        stay = []
        for text in frame["chunk_text"]:
            if not text:
                stay.append(True)
                continue
            h, own = T.simhash_value(text) or 0, set(text.lower().split()) if contained is not None else set()
            near = any((((h ^ o) & (2**64 - 1)).bit_count()) <= radius for o in hashes)
            inside = contained is not None and bool(own) and any(len(own & s) / len(own) >= contained for s in sets)
            stay.append(not (near or inside))
            if stay[-1]:
                hashes.append(h)
                sets.append(own)
        out = frame[stay].copy()
        out["final_rank"] = range(1, len(out) + 1)
        return out

    return _by_query(candidates).groupBy("query_id").applyInPandas(keep, candidates.withColumn("final_rank", F.lit(0)).schema)


def retrieve(
    chunks: DataFrame, queries: DataFrame, *, technique: str = "arithmetic_mean", keyword_weight: float = 0.3, top_k: int = 20, near_duplicates: bool = True,
    set_ids: list[str] | None = None, owner: str | None = None, keyword: bool = True, embed: Callable[[Column], Column] | None = None, reranker: Column | None = None,
) -> DataFrame:
    """Hybrid retrieval: chunks (chunk_id, text, vector, and document_id, enabled, set_id and owner if they have them), queries
    (query_id, text, and vector unless embed makes it of the text).

    One row a candidate, up to twice top_k a query: (query_id, chunk_id, document_id, document_name, chunk_text,
    vector_score, vector_rank, bm25_score, bm25_rank, fused, fused_rank, rerank_score, final_rank, assembled). keyword=False
    is a store without a text index. reranker: a score by the columns of the candidates; final_rank follows it, without one
    rerank_score is null."""
    if "vector" not in queries.columns:
        if embed is None:
            raise ValueError("queries need a vector, or embed to make one")
        queries = queries.withColumn("vector", embed(F.col("text")))
    if "enabled" in chunks.columns:
        chunks = in_scope(chunks, set_ids, owner)
    vectors = knn_topk(chunks, queries, top_k)
    fused = fuse(vectors, bm25_topk(chunks, queries, top_k) if keyword else vectors.where("false"), technique, keyword_weight, top_k)
    document = F.col("document_id") if "document_id" in chunks.columns else F.lit(None).cast("string")
    found = fused.join(chunks.select("chunk_id", document.alias("document_id"), F.col("text").alias("chunk_text")), "chunk_id")
    kept = drop_near_duplicates(found) if near_duplicates else found.withColumn("final_rank", F.col("fused_rank"))
    ranked = kept.withColumn("rerank_score", F.lit(None).cast("double")) if reranker is None else rerank(kept, reranker)
    first = ("query_id", "chunk_id", "document_id", F.lit("").alias("document_name"), "chunk_text")
    return ranked.select(*first, "vector_score", "vector_rank", "bm25_score", "bm25_rank", "fused", "fused_rank", "rerank_score", "final_rank", F.lit(False).alias("assembled"))


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """final_rank by a reranker's score (null: 0), earlier rank first on ties."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(score, F.lit(0.0))), "fused_rank")
    return candidates.withColumn("rerank_score", F.coalesce(score, F.lit(0.0))).withColumn("final_rank", F.row_number().over(order))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """The best hit of each chunk; ranks renumbered, null scores 0."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    again = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").withColumn("rank", F.row_number().over(again)).withColumn("score", F.coalesce("score", F.lit(0.0)))


def lost_in_the_middle(items: DataFrame, group: str, order: str) -> DataFrame:
    """items with position: the best first and last, the worst in the middle."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(group))
    return items.withColumn("_i", i).withColumn("_n", n).withColumn("position", F.when(F.col("_i") % 2 == 0, F.floor(F.col("_i") / 2)).otherwise(F.col("_n") - 1 - F.floor(F.col("_i") / 2)).cast("int")).drop("_i", "_n")


def maximal_marginal_relevance(items: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """Of each query's items (query_id, ord, score, text) the k chosen greedily by weight * score - (1 - weight) * the
    largest Jaccard similarity to a chosen one; mmr_rank is the order. Greedy on one query's candidates."""
    w = min(max(weight, 0.0), 1.0)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", kind="stable").reset_index(drop=True)
        sets = [{x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x} for t in frame["text"]]
        worst, left, picked = [0.0] * len(sets), list(range(len(sets))), []
        while left and len(picked) < k:
            best = max(left, key=lambda i: (w * frame["score"][i] - (1 - w) * worst[i], -i))
            picked.append(best)
            left.remove(best)
            for i in left:
                union = sets[i] | sets[best]
                worst[i] = max(worst[i], len(sets[i] & sets[best]) / len(union) if union else 1.0)
        out = frame.iloc[picked].copy()
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    return _by_query(items).groupBy("query_id").applyInPandas(choose, items.withColumn("mmr_rank", F.lit(0)).schema)


def auto_merge(children: DataFrame, parents: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Children (query_id, chunk_id, parent_id, score, text, and ord if they have it) whose parent (chunk_id, child_count,
    text) has enough of its children retrieved become one row of the parent, with the best score. Of a repeated child the
    first counts (by ord; without one the best). position is the order of the result: by score, and of equal scores those
    without a known parent first, then parents in the order in which they appear."""
    came = F.col("ord") if "ord" in children.columns else F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    placed = children.withColumn("_ord", came)
    once = placed.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("_ord"))).where("_k = 1").drop("_k")
    known = once.join(parents.select(F.col("chunk_id").alias("parent_id"), "child_count", F.col("text").alias("_ptext"), F.lit(True).alias("_has")), "parent_id", "left")
    group = Window.partitionBy("query_id", "parent_id")
    share = F.when(F.col("child_count") > 0, F.count("*").over(group) / F.col("child_count"))
    grouped = F.coalesce("_has", F.lit(False))
    marked = known.withColumn("_first", F.when(grouped, F.min("_ord").over(group))).withColumn("_merge", grouped & F.coalesce(share >= min(max(ratio, 0.0), 1.0), F.lit(False)))
    merged = marked.where("_merge").groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.first("_ptext").alias("text"), F.count("*").cast("int").alias("merged"), F.min("_first").alias("_first"), F.min("_ord").alias("_ord"))
    kept = marked.where("NOT _merge").select("query_id", "chunk_id", "parent_id", "score", "text", F.lit(0).alias("merged"), "_first", "_ord")
    out = kept.unionByName(merged.select("query_id", F.col("parent_id").alias("chunk_id"), F.lit(None).cast(dict(children.dtypes)["parent_id"]).alias("parent_id"), "score", "text", "merged", "_first", "_ord"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("_first"), "_ord")
    return out.withColumn("position", F.row_number().over(order)).drop("_first", "_ord")


def assemble_context(segments: DataFrame, budget: int, tokens: Column | None = None) -> DataFrame:
    """Of each query's segments (query_id, ord, chunk_id, text) the longest prefix within budget, the first always:
    (query_id, context_tokens, included, text)."""
    cost = F.size(T.words(F.col("text"))) if tokens is None else tokens
    upto = Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    kept = segments.withColumn("_cost", cost).withColumn("_sum", F.sum("_cost").over(upto)).withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where((F.col("_rn") == 1) | (F.col("_sum") <= budget))
    rows = F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "text")))
    return kept.groupBy("query_id").agg(F.sum("_cost").alias("context_tokens"), rows.alias("_rows")).select("query_id", "context_tokens", F.array_join(F.transform("_rows", lambda r: r["chunk_id"].cast("string")), ",").alias("included"), F.array_join(F.transform("_rows", lambda r: r["text"]), "\n\n").alias("text"))


def assemble_hops(hops: DataFrame, budget: int) -> DataFrame:
    """As assemble_context, over hops (query_id, hop, idx, chunk_id, text) taken in turn, the first mention of a chunk counting."""
    turn = Window.partitionBy("query_id").orderBy("idx", "hop")
    first = Window.partitionBy("query_id", "chunk_id").orderBy("idx", "hop")
    once = hops.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return assemble_context(once.withColumn("ord", F.row_number().over(turn)), budget)
