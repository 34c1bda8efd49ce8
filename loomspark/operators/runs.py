"""What surrounds a run: costs, prompts, grading of answers, and a registry of the tools that need no state."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T

from . import retrieval
from .shared import written


def cost_of(metrics: DataFrame, prices: DataFrame) -> DataFrame:
    """metrics (model, billing_mode, input_tokens, output_tokens) with cost: free stages cost 0, metered ones need a price."""
    priced = metrics.join(prices.select("model", "input_price", "output_price", F.lit(True).alias("_known")), "model", "left")
    price = F.coalesce("input_tokens", F.lit(0)) * F.col("input_price") + F.coalesce("output_tokens", F.lit(0)) * F.coalesce("output_price", F.lit(0.0))
    missing = F.raise_error(F.concat(F.lit("no price for "), F.coalesce("model", F.lit("null"))))
    cost = F.when(F.col("billing_mode") == "free", F.lit(0.0)).when(F.col("_known") & F.col("input_price").isNotNull(), price).otherwise(missing.cast("double"))
    return priced.withColumn("cost", cost).drop("_known", "input_price", "output_price")


def estimate_of(plans: DataFrame, prices: DataFrame) -> DataFrame:
    """plans (model, billing_mode, input_tokens) with estimate: what the input alone will cost; a metered stage needs a
    price here too."""
    return cost_of(plans.withColumn("output_tokens", F.lit(0)), prices).withColumnRenamed("cost", "estimate").drop("output_tokens")


def meter(stage: str, work: Callable[[], DataFrame]) -> tuple[DataFrame | None, dict]:
    """Run work, its jobs included, and tell (result, what it took): the result is written to the shared folder and read
    again. The error is noted and raised by the caller's choice."""
    began = time.monotonic()
    try:
        return written(work(), "metered"), {"stage": stage, "duration_ms": (time.monotonic() - began) * 1000, "error": None}
    except Exception as wrong:  # noqa: BLE001 - noted for the metrics
        return None, {"stage": stage, "duration_ms": (time.monotonic() - began) * 1000, "error": str(wrong)}


def canonical(value: object) -> str:
    """JSON with keys in the order of their code units, as stage keys need it; what JSON has no number for is null."""
    if isinstance(value, dict):
        rows = sorted(((str(k), v) for k, v in value.items()), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in rows) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return "null" if not math.isfinite(value) else str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    return json.dumps(value, ensure_ascii=False)


def graph_prompt(passage: str) -> str:
    """Asks a model for the entities of a passage and what relates them, in the form that graph.parse_reply reads."""
    form = '{"entities":[{"name":"...","type":"..."}],"relationships":[{"source":"...","target":"...","description":"..."}]}'
    return f"List the people, places, organisations, products and terms that this passage names, and how they are related.\nAnswer with JSON alone: {form}\n\nPassage:\n{passage}"


def contextualize(turns: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, prompt): the last turns (conv_id, turn, role, text) of each conversation, oldest first."""
    kept = turns.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_k") <= last)
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return kept.groupBy("conv_id").agg(rows.alias("_r")).select("conv_id", F.array_join(F.transform("_r", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n").alias("prompt"))


def grade(answers: DataFrame) -> DataFrame:
    """answers (question, answer, expect, reject) with grounded: the answer has expect and not reject ('' or null: none)."""
    bad = (F.coalesce("reject", F.lit("")) != "") & F.col("answer").contains(F.col("reject"))
    return answers.withColumn("grounded", F.coalesce(F.col("answer").contains(F.col("expect")) & ~F.coalesce(bad, F.lit(False)), F.lit(False)))


def gold_rank(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold_rank): the best rank of a candidate (query_id, final_rank, chunk_text) that has the gold (query_id,
    gold) text; null if none."""
    hit = candidates.join(gold, "query_id").where(F.col("chunk_text").contains(F.col("gold"))).groupBy("query_id").agg(F.min("final_rank").alias("gold_rank"))
    return gold.select("query_id").join(hit, "query_id", "left")


#: Most items, characters and tokens that a tool takes at a time.
MOST_ITEMS, MOST_TEXT, MOST_BUDGET = 200, 200_000, 1_000_000


def _bounded(tool: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The tool, refusing more than MOST_ITEMS rows a query and texts beyond MOST_TEXT."""

    def run(items: DataFrame, *args, **kwargs) -> DataFrame:
        if "query_id" in items.columns and not items.groupBy("query_id").count().where(F.col("count") > MOST_ITEMS).isEmpty():
            raise ValueError(f"more than {MOST_ITEMS} items")
        if "text" in items.columns and not items.where(F.length("text") > MOST_TEXT).isEmpty():
            raise ValueError(f"a text of more than {MOST_TEXT} characters")
        budget = kwargs.get("budget", args[0] if args and isinstance(args[0], int) else 0)
        if not 0 <= budget <= MOST_BUDGET:
            raise ValueError(f"budget must be 0..{MOST_BUDGET}")
        return tool(items, *args, **kwargs)

    return run


def parse_query_lists(replies: DataFrame, fallback: str = "") -> DataFrame:
    """replies (query_id, text) with queries, see text.parse_query_list."""
    return replies.withColumn("queries", T.parse_query_list(F.col("text"), F.lit(fallback)))


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "order-context": _bounded(retrieval.lost_in_the_middle),
    "diversify-candidates": _bounded(retrieval.maximal_marginal_relevance),
    "merge-to-parents": _bounded(retrieval.auto_merge),
    "assemble-context": _bounded(retrieval.assemble_context),
    "parse-query-list": _bounded(parse_query_lists),
    "retrieve": retrieval.retrieve,
}
