"""Mixing sources to target weights: exact block quotas, split among output shards by a multivariate-hypergeometric tree.

Every source is cut into blocks of block_rows rows. Its quota of blocks follows from the target weights, by largest
remainders. Given weights are kept exactly, so the total is the largest for which no source has to give more blocks than
it has; a given total, or without weights all blocks, is met instead by what the others have where a source runs short.
Shards form a binary
tree: at each node the blocks of its subtree are split between its two sides by a draw from the multivariate
hypergeometric distribution over sources, so the quotas stay exact and every shard gets its number of blocks. A shard
takes, of each source, the next blocks of a keyed permutation, and shuffles its rows by a keyed hash.

The tree is walked where it is needed: a task derives the path to its shards from (seed, node), in as many draws as the
tree is deep; the driver only sees one count for each source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class MixingParams:
    #: Weight of each source; None: row counts to the power of temperature, the usual smoothing of a natural mix.
    weights: tuple[tuple[str, float], ...] | None = None
    temperature: float = 0.7
    #: Blocks of the mix. None: as many as keep given weights exact, and all there are where no weights are given.
    total: int | None = None
    block_rows: int = 16
    #: Blocks that a shard aims at.
    shard_blocks: int = 256
    #: Hash buckets by which rows are ranked within a source, so that a hot source isn't sorted by one task.
    rank_buckets: int = 4096
    seed: int = 17


def quotas(blocks: dict[str, int], weights: dict[str, float], most: int | None = None) -> dict[str, int]:
    """Blocks of each source: weights scaled by the largest total that all sources can meet, rounded by largest
    remainders (ties by name), never beyond what a source has. Sources of weight 0, or without one, give none.

    With most, the total is that, or all blocks of the sources with a weight if they are fewer: a source that falls
    short gives all it has, and the others share the rest by weight."""
    live = {s: weights.get(s, 0.0) for s, n in blocks.items() if n > 0 and weights.get(s, 0.0) > 0}
    if not live:
        return dict.fromkeys(blocks, 0)
    whole = sum(live.values())
    total = min(blocks[s] / (w / whole) for s, w in live.items())
    exact = {s: total * w / whole for s, w in live.items()}
    if most is not None:
        total = min(most, sum(blocks[s] for s in live))
        rest, free = float(total), whole
        for s in sorted(live, key=lambda s: (blocks[s] / live[s], s)):  # the scarcest for its weight first
            exact[s] = min(blocks[s], rest * live[s] / free)
            rest, free = rest - exact[s], free - live[s]
            if free <= 0:
                break
    out = {s: min(int(x + 1e-9), blocks[s]) for s, x in exact.items()}
    spare = int(total + 1e-9) - sum(out.values())
    for s in sorted(live, key=lambda s: (-(exact[s] - out[s]), s)):
        if spare > 0 and out[s] < blocks[s]:
            out[s] += 1
            spare -= 1
    return {s: out.get(s, 0) for s in blocks}


def draw(good: int, bad: int, many: int, rng: np.random.Generator) -> int:
    """A draw from the hypergeometric distribution: how many of `many` drawn are good. The generator takes counts below
    1e9 only; beyond, the distribution itself is summed over all values within 14 standard deviations and 70 of its mode,
    outside which lies less than 1e-40 of it, also where a source is so rare that its draws are few."""
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, many))
    low, high, whole = max(0, many - bad), min(many, good), good + bad
    spread = np.sqrt(many * (good / whole) * (bad / whole) * ((whole - many) / max(whole - 1, 1)))
    mode = (many + 1) * (good + 1) // (whole + 2)
    low, high = max(low, int(mode - 14 * spread) - 70), min(high, int(mode + 14 * spread) + 70)
    x = np.arange(low, high, dtype=np.float64)
    step = np.log(good - x) + np.log(many - x) - np.log(x + 1) - np.log(bad - many + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among `left` draws without replacement."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        out[i] = draw(n, rest - n, left, rng) if n and left else 0
        rest -= n
        left -= int(out[i])
    return out


def shard_sizes(total: int, low: int, high: int, shards: int) -> int:
    """Blocks of the shards low..high-1 of an even division."""
    return total * high // shards - total * low // shards


def leaf(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, blocks) of each source in this shard: the path from the root, each draw seeded by its node."""
    total, low, high = int(counts.sum()), 0, shards
    first = np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(counts, shard_sizes(total, low, middle, shards), np.random.default_rng([seed, low, high]))
        if shard < middle:
            counts, high = left, middle
        else:
            first, counts, low = first + left, counts - left, middle
    return first, counts


def permuted(x: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A keyed bijection of range(size), elementwise: four Feistel rounds with cycle walking."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            f = (b + np.uint64((salt * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (a << np.uint64(half)) | b
        todo = todo[x[todo] >= size]
    return x.astype(np.int64)


def plan(spark: SparkSession, blocks: dict[str, int], quota: dict[str, int], params: MixingParams) -> DataFrame:
    """(_source, _block, shard): the chosen blocks, made shard by shard on the executors."""
    names = sorted(quota)
    counts = np.array([quota[s] for s in names], np.int64)
    have = [blocks[s] for s in names]
    shards = max(1, -(-int(counts.sum()) // params.shard_blocks))
    seed = params.seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                first, many = leaf(counts, shards, int(shard), seed)
                for i in np.flatnonzero(many):
                    place = np.arange(first[i], first[i] + many[i])
                    yield pd.DataFrame({"_source": names[i], "_block": permuted(place, have[i], seed * 1009 + int(i)), "shard": shard})

    return spark.range(0, shards, 1, max(1, min(shards // 8, 1024))).mapInPandas(run, "_source string, _block bigint, shard bigint")


def _ranked(ids: DataFrame, params: MixingParams) -> DataFrame:
    """ids (_source, _id, ...) with _rank, the exact 0-based place in its source by (bucket, hash, id): buckets are
    counted first, so that no task sorts a whole source."""
    hashed = F.xxhash64(F.lit(params.seed), "_id")
    keyed = ids.withColumn("_h", hashed).withColumn("_bucket", F.pmod("_h", F.lit(params.rank_buckets)))
    count = keyed.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_h", "_id")
    numbered = keyed.withColumn("_k", F.row_number().over(within) - 1)
    return numbered.join(offset, ["_source", "_bucket"]).withColumn("_rank", F.col("_offset") + F.col("_k")).drop("_bucket", "_offset", "_k")


def assign(docs: DataFrame, params: MixingParams = MixingParams()) -> DataFrame:
    """(doc_id, source, block, shard, position) of the rows that the mix takes.

    Rows with a null doc_id can't be placed and aren't taken. A null source counts as a source of its own, named ''.
    Repeated doc_ids are one row each in their source. Sources without a weight aren't taken. The last block of a
    source may be short. Other columns are ignored; empty tables give an empty result."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("source"), F.lit("")).alias("_source")).where("_id IS NOT NULL").distinct()
    rows = {r["_source"]: r["n"] for r in ids.groupBy("_source").agg(F.count("*").alias("n")).collect()}  # one row a source
    blocks = {s: -(-n // params.block_rows) for s, n in rows.items()}
    weights = dict(params.weights) if params.weights is not None else {s: n**params.temperature for s, n in rows.items()}
    most = sum(blocks.values()) if params.total is None and params.weights is None else params.total
    chosen = plan(spark, blocks, quotas(blocks, weights, most), params)
    ranked = _ranked(ids, params).withColumn("_block", F.floor(F.col("_rank") / params.block_rows))
    taken = ranked.join(chosen, ["_source", "_block"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(params.seed + 1), "shard", "_id", "_source"), "_id", "_source")
    return taken.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_block").alias("block"), "shard", (F.row_number().over(order) - 1).cast("bigint").alias("position"))


def mix(docs: DataFrame, params: MixingParams = MixingParams()) -> DataFrame:
    """The rows of docs that the mix takes, columns as they are, laid out by shard in shuffled order.

    Repeated rows of a doc_id go together; null and empty texts count as any row, however long others are. Columns may have
    any name. An empty table gives an empty one. Where neither weights nor a total leave rows out, those with a null doc_id stay too, after the shards."""
    own = [f"_{x}_{uuid.uuid4().hex}" for x in ("id", "source", "shard", "position")]
    where = assign(docs, params).select(*[F.col(c).alias(a) for c, a in zip(("doc_id", "source", "shard", "position"), own)])
    joined = docs.join(where, (docs["doc_id"] == where[own[0]]) & (F.coalesce(docs["source"], F.lit("")) == where[own[1]]))
    out = joined.repartition(own[2]).sortWithinPartitions(own[2], own[3]).drop(*own)
    return out.unionByName(docs.where("doc_id IS NULL")) if params.weights is None and params.total is None else out


def report(docs: DataFrame, params: MixingParams = MixingParams()) -> DataFrame:
    """(source, rows_in, rows_out): distinct (doc_id, source) of non-null doc_id, and how many of them the mix takes."""
    source = F.coalesce(F.col("source"), F.lit("")).alias("source")
    have = docs.where("doc_id IS NOT NULL").select("doc_id", source).distinct().groupBy("source").agg(F.count("*").alias("rows_in"))
    taken = assign(docs, params).groupBy("source").agg(F.count("*").alias("rows_out"))
    return have.join(taken, "source", "left").select("source", "rows_in", F.coalesce("rows_out", F.lit(0)).alias("rows_out"))


#: Target weights of the query: every source alike but the first, which the tables have far more of, with twice that.
TARGETS = MixingParams(weights=(("src0", 2.0), *((f"src{k}", 1.0) for k in range(1, 20))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix at exactly the target weights, as large as the scarcest source for its weight allows."""
    return assign(table(spark, sf_dir, "documents"), TARGETS)


QUERIES = {"op5_mixing": op5_mixing}
ORACLE: dict[str, str] = {}
