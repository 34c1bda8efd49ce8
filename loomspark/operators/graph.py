"""Entities and relationships of a corpus: vectors by similarity, mentions by name, communities."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T

from .shared import written

SIMILARITY_FLOOR = 0.35
MEMBERS_SHOWN = 24


def rank_by_similarity(vectors: DataFrame, query: list[float], limit: int, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """(name, score, rank) of the vectors (name, vec) nearest to query; null and empty ones don't count."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where("vec IS NOT NULL AND size(vec) > 0").select("name", F.round(T.cosine(F.col("vec"), q), 9).alias("score")).where(F.col("score") >= floor)
    top = scored.orderBy(F.desc("score"), "name").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "name")))


def dedupe_entities(mentions: DataFrame) -> DataFrame:
    """(key, name, mentions, chunks) of mentions (chunk_id, name, type): one row for each normalised name, blank ones
    left out; name is the smallest spelling."""
    keyed = mentions.withColumn("key", T.normalize_name(F.col("name"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("mentions"), F.count_distinct("chunk_id").alias("chunks"))


def _write(df: DataFrame) -> DataFrame:
    return written(df, "labels")


def entity_text(name: Column, kind: Column) -> Column:
    """What stands for an entity when it is embedded."""
    return F.concat(name, F.lit(" ("), kind, F.lit(")"))


def relationship_text(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" — "), target)


def community_text(summary: Column, members: Column) -> Column:
    """The summary of a community, else its first members."""
    return F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", summary).otherwise(F.array_join(F.slice(members, 1, MEMBERS_SHOWN), ", "))


def communities(edges: DataFrame) -> DataFrame:
    """(member, community): connected components of edges (source, target), named by their smallest member. Labels run
    over edges and jump to the label of the label, so a chain needs few rounds. Blank ends and self-edges don't count."""
    e = edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").where("trim(cast(source AS string)) <> '' AND trim(cast(target AS string)) <> ''").select("source", "target")
    both = _write(e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    now = _write(both.groupBy("source").agg(F.min("target").alias("_m")).select(F.col("source").alias("member"), F.least("source", "_m").alias("community")))
    while True:
        over = both.join(now.select(F.col("member").alias("target"), F.col("community").alias("_c")), "target").groupBy("source").agg(F.min("_c").alias("_c"))
        near = now.join(over, now["member"] == over["source"]).select("member", F.col("community").alias("_old"), F.least("community", "_c").alias("_new"))
        jump = now.select(F.col("member").alias("_new"), F.col("community").alias("_far"))
        after = _write(near.join(jump, "_new").select("member", "_old", F.least("_new", "_far").alias("community")))
        settled = after.where("_old <> community").isEmpty()
        now = after.select("member", "community")
        if settled:
            return now


def community_sizes(found: DataFrame) -> DataFrame:
    """(community, size, members): the first members in order, joined by commas."""
    rows = found.withColumn("_k", F.row_number().over(Window.partitionBy("community").orderBy("member")))
    shown = F.array_sort(F.collect_list(F.when(F.col("_k") <= MEMBERS_SHOWN, F.col("member").cast("string"))))
    return rows.groupBy("community").agg(F.count("*").alias("size"), F.array_join(shown, ", ").alias("members"))


def is_degenerate(found: DataFrame, share: float = 0.5) -> DataFrame:
    """(degenerate): no community, or one that holds more than share of all members."""
    sizes = found.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")) > share, F.lit(True)).alias("degenerate"))


def parse_reply(raw: str | None, passage: str | None = None) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(entities (name, type), relationships (source, target, description)) of a model's JSON reply. Names of one letter or
    a number alone are dropped; with a passage, names must occur in it and ends are resolved to them."""
    bare = re.sub(r"^```\w*|```$", "", (raw or "").strip()).strip()
    try:
        data = json.loads(bare)
    except ValueError:
        return [], []
    if not isinstance(data, dict):
        return [], []
    rows = lambda key: [r for r in data.get(key) or [] if isinstance(r, dict)]
    fold = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", str(s or "").lower())).strip()
    entities: dict[str, tuple[str, str]] = {}
    for r in rows("entities"):
        name = str(r.get("name") or "").strip()
        if len(name) < 2 or re.fullmatch(r"[\d.,\s]+", name) or passage is not None and fold(name) not in fold(passage):
            continue
        entities.setdefault(fold(name), (name, str(r.get("type") or "")))

    def resolved(end: str) -> str | None:
        key = fold(end)
        if passage is None:
            return str(end).strip() or None
        if key in entities:
            return entities[key][0]
        return next((n for k, (n, _) in entities.items() if key and set(key.split()) <= set(k.split())), None)

    seen, edges = set(), []
    for r in rows("relationships"):
        a, b = resolved(r.get("source") or ""), resolved(r.get("target") or "")
        if not a or not b or a == b or frozenset((a, b)) in seen:
            continue
        seen.add(frozenset((a, b)))
        edges.append((a, b, str(r.get("description") or "")))
    return list(entities.values()), edges


def parse_extraction(replies: DataFrame) -> DataFrame:
    """replies (chunk_id, raw, passage) with entities and relationships, each stamped with nothing but its own row."""

    @F.pandas_udf("entities array<struct<name:string,type:string>>, relationships array<struct<source:string,target:string,description:string>>")
    def parsed(raw: pd.Series, passage: pd.Series) -> pd.DataFrame:
        both = [parse_reply(r, p) for r, p in zip(raw, passage)]
        return pd.DataFrame({"entities": [[{"name": n, "type": t} for n, t in e] for e, _ in both], "relationships": [[{"source": a, "target": b, "description": d} for a, b, d in r] for _, r in both]})

    return replies.select("chunk_id", parsed("raw", "passage").alias("_p")).select("chunk_id", "_p.*")


def match_entity_names(questions: DataFrame, names: DataFrame, share: float = 0.6) -> DataFrame:
    """(query_id, name): names (name) that a question (query_id, text) contains whole, or of which it has at least two
    words and that share of them. Joined on words, not question by name."""
    q = questions.select("query_id", T.normalize_name(F.col("text")).alias("_t"))
    qw = q.select("query_id", "_t", F.explode(F.array_distinct(F.split("_t", " "))).alias("w"))
    n = names.select("name", T.normalize_name(F.col("name")).alias("_n")).where("_n <> ''").distinct()
    nw = n.select("name", "_n", F.size(F.array_distinct(F.split("_n", " "))).alias("_size"), F.explode(F.array_distinct(F.split("_n", " "))).alias("w"))
    met = qw.join(nw, "w").groupBy("query_id", "name", "_t", "_n", "_size").agg(F.count("*").alias("_k"))
    whole = F.concat(F.lit(" "), "_t", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("_n"), F.lit(" ")))
    return met.where(whole | ((F.col("_k") >= 2) & (F.col("_k") / F.col("_size") >= share))).select("query_id", "name")
