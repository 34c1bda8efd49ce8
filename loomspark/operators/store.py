"""The chunk table as an index: idempotent writes, deletions, clones, counts, and vectors kept by text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from loomspark.functions import text as T

from .shared import NUMBERS, Holders, in_blocks, runs_within, spread, written


def open_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one of that schema where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def append(fresh: DataFrame, path: str, key: str = "chunk_id") -> int:
    """Write new rows to the index at path, which is how many; a key that repeats among them is an error, and then none is
    written."""
    kept = written(fresh, "fresh")
    again = kept.groupBy(key).count().where("count > 1").select(key).first()
    if again is not None:
        raise ValueError(f"{key} {again[0]} comes twice")
    kept.write.mode("append").parquet(path)
    return kept.count()


def ensure_vector_field(index: DataFrame, model: str) -> DataFrame:
    """The index with the column that holds a model's vectors, null where it hadn't one."""
    import hashlib

    name = f"vec_{hashlib.sha256(model.encode()).hexdigest()[:16]}"
    return index if name in index.columns else index.withColumn(name, F.lit(None).cast("array<float>"))


def upsert(index: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """index with the rows of fresh in place of those of the same key."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete_ids(index: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti")


def clone(index: DataFrame, owner: str, new_owner: str, chunks: DataFrame, sets: DataFrame, documents: DataFrame) -> DataFrame:
    """index and copies of the owner's rows under new ids: maps are (old, new); a chunk without one isn't copied, sets
    and documents without one keep their id."""
    own = index.where(F.col("owner") == owner)
    named = lambda m, c: m.select(F.col("old").alias(c), F.col("new").alias(f"_{c}"))
    mapped = own.join(named(chunks, "chunk_id"), "chunk_id").join(named(sets, "set_id"), "set_id", "left").join(named(documents, "document_id"), "document_id", "left")
    fresh = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("chunk_id", "set_id", "document_id")} | {"owner": F.lit(new_owner)}
    copies = mapped.select(*[fresh.get(c, F.col(c)).alias(c) for c in index.columns])
    return index.unionByName(copies)


def searchable_count(index: DataFrame) -> DataFrame:
    """(set_id, n): enabled or not, whoever's."""
    return index.groupBy("set_id").agg(F.count("*").alias("n"))


CACHE_DAYS = 30


def cache_key(kind: str, *parts: Column) -> Column:
    """'emb' over model and text, 'ctx' over model, document hash and text: parts are joined by spaces."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.concat_ws(" ", F.lit({"emb": "embed-1", "ctx": "ctx-1"}[kind]), *parts), 256))


def cached(keyed: DataFrame, cache: DataFrame, days: int = CACHE_DAYS, value: str = "vector") -> DataFrame:
    """keyed (key, ...) with value, null where the cache (key, value, cached_at) has none younger than days."""
    fresh = cache.where(F.col("cached_at") > F.current_timestamp() - F.make_dt_interval(F.lit(days))).groupBy("key").agg(F.max_by(value, "cached_at").alias(value))
    return keyed.join(fresh, "key", "left")


def remember(cache: DataFrame, found: DataFrame, value: str = "vector") -> DataFrame:
    """The cache (key, value, cached_at) with what was found (key, value) in place of what it had of those keys."""
    return cache.join(found.select("key").distinct(), "key", "left_anti").unionByName(found.select("key", value, F.current_timestamp().alias("cached_at")))


def normalized(c: Column) -> Column:
    """Unicode NFC, for which there is no built-in function; texts that can't change by it aren't sent to Python."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts], dtype=object)

    return F.coalesce(nfc(F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)), c)


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(text) in NFC, without null. Null is told before and not after NFC: a condition on its result is a second pass, with
    workers of its own beside those of the first."""
    return texts.where("text IS NOT NULL").select(normalized(F.col("text")).alias("text")).distinct()


def embed_texts(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[Column], Column], days: int = CACHE_DAYS) -> DataFrame:
    """(text, key, vector) of the distinct texts, in NFC: from the cache (key, vector, cached_at) if younger than days, else
    by embed, a column function; texts go to it ordered by length, so that a batch has little padding. Vectors of
    different lengths are an error."""
    keyed = cached(distinct_texts(texts).withColumn("key", cache_key("emb", F.lit(model), F.col("text"))), cache, days)
    missed = keyed.where("vector IS NULL").sortWithinPartitions(F.length("text"))
    out = written(keyed.where("vector IS NOT NULL").select("text", "key", "vector").unionByName(missed.select("text", "key", embed(F.col("text")).alias("vector"))), "embedded")
    sizes = out.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of {sizes['a']} and of {sizes['b']} numbers")
    return out


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(checksum, first_id, n) of the texts that occur more than once."""
    return docs.groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND checksum IS NOT NULL")


def print_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, h): documents of equal SimHash are a class, named by the smallest id."""
    prints = written(spread(docs.where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", T.simhash(F.col("text")).alias("h")), "prints")
    return prints.join(prints.groupBy("h").agg(F.min("doc_id").alias("class_id")).hint("merge"), "h").select("doc_id", "class_id", "h")


def near_pairs(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance) of the classes (class_id, h) whose SimHashes differ in radius bits or fewer, a < b; with the
    membership these are all pairs of documents. Of radius + 3 parts of the bits at least three must agree, so pairs are
    looked for among those that agree in some three: exact, with keys of about 192 / (radius + 3) bits. Each class has a
    key for each choice of three, which Spark's estimate of the size leaves out: the join is told not to broadcast them."""
    parts = radius + 3
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    mask = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(signed(sum(three))).cast("bigint")) for three in combinations(mask, 3)]))
    heads = classes.select("class_id", "h").distinct()
    keyed = heads.select("class_id", "h", keys.alias("way", "key"))
    met = keyed.alias("x").join(keyed.alias("y").hint("merge"), ["way", "key"]).where("x.class_id < y.class_id").select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"), T.hamming(F.col("x.h"), F.col("y.h")).alias("distance"))
    return met.where(F.col("distance") <= radius).distinct()


def containment(items: DataFrame, docs: DataFrame, share: float = 0.9, block_bytes: int = 32 << 20) -> DataFrame:
    """(item_id, doc_id, share) of the items (item_id, text) of whose words a document (doc_id, text) has that share.
    Every task holds the items, in blocks of block_bytes of text, and reads its documents once: no shuffle."""
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return reduce(DataFrame.unionByName, [_containment_block(part, docs, share) for part in in_blocks(asked, F.octet_length("text"), block_bytes, "item_id")])


def _containment_block(items: DataFrame, docs: DataFrame, share: float) -> DataFrame:
    rows = items.collect()  # a block
    words = [T.word_list(r["text"]) for r in rows]
    size = np.array([len(set(w)) for w in words], np.float64)
    held = docs.sparkSession.sparkContext.broadcast((Holders(words), size, np.array([r["item_id"] for r in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, size, ids = held.value
        flat = lambda terms: (np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.array([x for t in terms for x in t], np.int64))
        for whole in batches if holders.n else ():
            found = [[holders.place[w] for w in set(T.word_list(t)) if w in holders.place] for t in whole.column(1).to_pylist()]
            for a, b in runs_within(holders.numbers(*flat(found), len(found)), NUMBERS):
                batch, (row, term) = whole.slice(a, b - a), flat(found[a:b])
                many = holders.spread(row, term, np.ones(len(term)), batch.num_rows)
                q, r = np.nonzero((many > 0) & (many >= share * size[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(0).take(pa.array(r)), pa.array(np.round(many[q, r] / size[q], 6))], ["item_id", "doc_id", "share"])

    kinds = [f"item_id {dict(items.dtypes)['item_id']}", f"doc_id {dict(docs.dtypes)['doc_id']}"]
    return spread(docs.where("text IS NOT NULL").select("doc_id", "text")).mapInArrow(run, ", ".join([*kinds, "share double"]))
