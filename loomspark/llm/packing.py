"""Packing training examples under simultaneous limits on tokens, segments and loss-bearing tokens.

Vector bin packing by the dot-product heuristic: one bin is open; of the examples that fit, it takes the one whose
demand has the largest weighted dot product with what is left of the bin, a dimension weighing as much as it is in
demand on average; when none fits, the next bin opens. Examples are dealt by hash into groups of about group_rows, each
packed by one task on its own; a group's last bin is the only one that another group could have filled.

An example beyond a limit is cut where its own segments and loss-bearing tokens lie, each piece as long as the limits
let it be."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread, table


@dataclass(frozen=True)
class PackingParams:
    tokens: int = 4096
    segments: int = 64
    loss_tokens: int = 3072
    #: Examples dealt to one task; a bin holds a few dozen, so the one unfilled bin at its end hardly counts.
    group_rows: int = 4096
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    seed: int = 23

    @property
    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.float64)


#: Of a byte-level vocabulary: words with the space before them, numbers, signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict = {}


def encoder(vocabulary: bytes):
    """Of the lines of a vocabulary (base64 token, rank), kept for as long as the worker lives."""
    import tiktoken

    if vocabulary not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def count_column(spark: SparkSession, text, vocabulary: str):
    """Tokens of the whole text; 0 for a null one. The vocabulary is read on the driver and sent to the executors, which
    needn't have the file: it is as large as the vocabulary, whatever the corpus."""
    with open(vocabulary, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(held.value).encode_ordinary
        return pd.Series([0 if t is None else len(encode(t)) for t in texts], dtype="int64")

    return count(text)


def pack_group(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, position) of each row of demand (n x dimensions, in the order in which ties are taken). Every row must fit
    an empty bin."""
    n = len(demand)
    bins, place = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    need = demand / limits
    weight = need.mean(0) if n else np.zeros(len(limits))
    # the largest dot product with a whole bin first, so that a tie goes to the earliest of them
    order = np.argsort(-(need @ weight), kind="stable")
    left, value = need[order], (need * weight)[order]
    alive, index = np.ones(n, bool), order
    bin_, gone = 0, 0
    while alive.any():
        room, k = np.ones(len(limits)), 0
        while True:
            score = value @ room
            score[~(alive & (left <= room + 1e-9).all(1))] = -1.0
            best = int(score.argmax())
            if score[best] < 0:
                break
            bins[index[best]], place[index[best]] = bin_, k
            room, alive[best] = room - left[best], False
            k, gone = k + 1, gone + 1
            if gone * 4 > len(alive):
                left, value, index = left[alive], value[alive], index[alive]
                alive, gone = np.ones(len(index), bool), 0
                if not len(index):
                    break
        bin_ += 1
    return bins, place


def cut(layout: list[tuple[int, int]], limits: tuple[int, int, int]) -> list[tuple[int, int, int, int]]:
    """(start, tokens, segments, loss_tokens) of the fewest consecutive pieces of an example that each stay within the
    limits. layout has (tokens, loss-bearing ones, which come last) of each segment; one that is cut counts as a segment
    in each piece that holds some of it."""
    out: list[tuple[int, int, int, int]] = []
    at, start, tokens, segments, loss = 0, 0, 0, 0, 0
    for n, bearing in layout:
        free, rest, begun = n - bearing, bearing, False
        while free or rest or not begun:
            a = min(free, limits[0] - tokens)
            b = min(rest, limits[0] - tokens - a, limits[2] - loss) if a == free else 0
            if segments == limits[1] or (n and not a + b):
                out.append((start, tokens, segments, loss))
                start, tokens, segments, loss = at, 0, 0, 0
                continue
            at, tokens, segments, loss, free, rest, begun = at + a + b, tokens + a + b, segments + 1, loss + b, free - a, rest - b, True
            if free or rest:
                out.append((start, tokens, segments, loss))
                start, tokens, segments, loss = at, 0, 0, 0
    return [*out, (start, tokens, segments, loss)]


def pieces(examples: DataFrame, params: PackingParams) -> DataFrame:
    """Examples beyond a limit, cut; others are piece 0 of 1. With a column layout they are cut where their segments and
    loss-bearing tokens lie; without, tokens, segments and loss tokens are taken to be spread evenly over an example,
    which is cut into the fewest equal pieces that each fit."""
    limits = (params.tokens, params.segments, params.loss_tokens)
    names = ("tokens", "segments", "loss_tokens")
    over = F.greatest(*[F.col(c) > m for c, m in zip(names, limits)])
    whole = examples.where(~over).select("id", F.lit(0).cast("bigint").alias("piece"), F.lit(1).cast("bigint").alias("pieces"), F.lit(0).cast("bigint").alias("start"), "tokens", F.greatest(F.lit(1), "segments").cast("bigint").alias("segments"), "loss_tokens")
    if "layout" in examples.columns:

        @F.pandas_udf("array<struct<start: bigint, tokens: bigint, segments: bigint, loss_tokens: bigint>>")
        def parts(layouts: pd.Series) -> pd.Series:
            return pd.Series([[dict(zip(("start", *names), p)) for p in cut([(int(x["tokens"]), int(x["loss_tokens"])) for x in layout], limits)] for layout in layouts], dtype="object")

        long = examples.where(over).select("id", parts("layout").alias("parts")).select("id", F.size("parts").cast("bigint").alias("pieces"), F.posexplode("parts").alias("piece", "x"))
        return whole.unionByName(long.select("id", F.col("piece").cast("bigint").alias("piece"), "pieces", "x.*"))
    cuts = F.greatest(*[F.ceil(F.col(c) / m) for c, m in zip(names, limits)]).cast("bigint")
    share = lambda c: (F.floor(F.col(c) * (F.col("piece") + 1) / F.col("pieces")) - F.floor(F.col(c) * F.col("piece") / F.col("pieces"))).cast("bigint").alias(c)
    some = examples.where(over).withColumn("pieces", cuts).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    start = F.floor(F.col("tokens") * F.col("piece") / F.col("pieces")).cast("bigint").alias("start")
    return whole.unionByName(some.select("id", "piece", "pieces", start, share("tokens"), F.greatest(F.lit(1), share("segments")).cast("bigint").alias("segments"), share("loss_tokens")))


def pack(examples: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """(id, piece, pieces, start, tokens, segments, loss_tokens, pack_id, position) of examples (id, tokens, segments,
    loss_tokens, and layout if they have it: an array of tokens and loss_tokens of each segment).

    Nulls in the demands count as 0; null ids and repeated rows are packed like any other. An example without tokens
    takes a segment. One beyond a limit is cut (see pieces), start being the first token of each piece. Ties go by the
    hash of id, then by size. Other columns are ignored; an empty table gives an empty result."""
    if min(params.tokens, params.segments, params.loss_tokens) < 1:
        raise ValueError("each limit is 1 at least")
    given = examples.select("id", *[F.greatest(F.lit(0), F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(c) for c in ("tokens", "segments", "loss_tokens")], *[c for c in examples.columns if c == "layout"])
    ready = materialize(pieces(materialize(given, "packing-examples"), params), "packing-pieces")  # texts are tokenized once
    groups = max(1, round(ready.count() / params.group_rows))
    hashed = F.xxhash64(F.lit(params.seed), "id", "piece", "tokens", "segments", "loss_tokens")
    limits = params.limits

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_h", "id", "piece", "tokens", "segments", "loss_tokens"], kind="stable").reset_index(drop=True)
        bins, place = pack_group(frame[["tokens", "segments", "loss_tokens"]].to_numpy(np.float64), limits)
        return frame.drop(columns=["_h"]).assign(pack_id=frame["_group"].astype("int64") * (1 << 32) + bins, position=place).drop(columns=["_group"])

    kind = examples.schema["id"].dataType.simpleString()
    dealt = ready.withColumn("_h", hashed).withColumn("_group", F.pmod("_h", F.lit(groups)))
    out = f"id {kind}, piece bigint, pieces bigint, start bigint, tokens bigint, segments bigint, loss_tokens bigint, pack_id bigint, position bigint"
    return dealt.groupBy("_group").applyInPandas(run, out)


def conversation_examples(conversations: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """(id, tokens, segments, loss_tokens, layout) of each conversation: a segment for each turn, in order, loss on the
    assistant's. A null text has no tokens but is a segment; null ids are one conversation."""
    turns = spread(conversations.select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", count_column(conversations.sparkSession, F.col("text"), params.vocabulary).alias("_n"))
    loss = F.when(F.col("role") == "assistant", F.col("_n")).otherwise(0).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.col("role"), F.col("_n").alias("tokens"), loss.alias("loss_tokens"))))
    layout = F.transform(ordered, lambda x: F.struct(x["tokens"].alias("tokens"), x["loss_tokens"].alias("loss_tokens")))
    return turns.groupBy(F.col("conv_id").alias("id")).agg(F.sum("_n").alias("tokens"), F.count("*").alias("segments"), F.sum(loss).alias("loss_tokens"), layout.alias("layout"))


def document_examples(docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """(id, tokens, segments, loss_tokens, layout) of each row of docs: one segment, loss on every token but the first."""
    n = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), count_column(docs.sparkSession, F.col("text"), params.vocabulary).alias("tokens"))
    loss = F.greatest(F.lit(0).cast("bigint"), F.col("tokens") - 1)
    return n.select("id", "tokens", F.lit(1).cast("bigint").alias("segments"), loss.alias("loss_tokens"), F.array(F.struct(F.col("tokens"), loss.alias("loss_tokens"))).alias("layout"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(conversation_examples(table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")


QUERIES = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
