"""Tables in the folder that all executors share, and query batches in blocks that fit a task's memory."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the numbers that are made at once of a batch of rows and a batch of queries.
NUMBERS = 1_000_000


def short_batches(spark: SparkSession, rows: int = 512, size: str = "4m") -> None:
    """Fewer rows and bytes in an Arrow batch than by default, since texts can be long and a worker holds several copies of
    a batch; a session's own settings stay."""
    for name, usual, own in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(name := f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(name, own)


def runs_within(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) of rows in a row whose sizes sum to limit or less; a row that is larger is alone."""
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder (spark.checkpoint.dir) and read again: it isn't computed anew, and a lost
    executor costs nothing of it. Only where that is unset and all runs on this machine a temporary folder is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores, where its scan has fewer: a file of one row group is one part, however much
    is then done with each row. A scan of many parts, and whatever isn't a plain scan, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(x in plan for x in ("Exchange", "Python", "Pandas", "InArrow")) or df.isStreaming:
        return df
    return df.repartition(cores) if df._jdf.toJavaRDD().getNumPartitions() < cores else df


def in_blocks(queries: DataFrame, size: Column, limit: int, key: str = "query_id") -> list[DataFrame]:
    """queries in as many parts as keep the sum of size of each about within limit; one part for a usual batch."""
    n = max(1, -(-int(queries.agg(F.sum(size)).first()[0] or 0) // limit))
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [queries] if n == 1 else [queries.where(part == b) for b in range(n)]


def id_array(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class TopK:
    """The k rows of the largest score for each of a batch of queries, ties by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, 0), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        """score: queries x ids, minus infinity where a row doesn't answer a query."""
        order = np.argsort(ids, kind="stable")
        ids, score = ids[order], score[:, order]
        near = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        found, s = ids[near], np.take_along_axis(score, near, 1)
        if self.ids is not None:
            found, s = np.concatenate([self.ids, found], 1), np.concatenate([self.score, s], 1)
            top = np.lexsort((found, -s), axis=1)[:, : self.k]
            found, s = np.take_along_axis(found, top, 1), np.take_along_axis(s, top, 1)
        self.ids, self.score = found, s

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of what was found."""
        if self.ids is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, j = np.nonzero(np.isfinite(self.score))
        return q, self.ids[q, j], self.score[q, j]


class Holders:
    """Which queries of a batch have a term, to count or to weigh a row's terms for all of them at once."""

    def __init__(self, terms: list[list[str]]):
        self.n = len(terms)
        self.place = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
        pairs = sorted((self.place[t], q) for q, own in enumerate(terms) for t in set(own))
        self.query = np.array([q for _, q in pairs], np.int64)
        self.start = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.place) + 1))

    def numbers(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """How many numbers spread makes for each of the rows."""
        return self.n + np.bincount(row, weights=self.start[term + 1] - self.start[term], minlength=rows).astype(np.int64)

    def spread(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """(queries x rows): for each the sum of the weights of the row's terms that the query has, in term order."""
        many = self.start[term + 1] - self.start[term]
        entry = np.repeat(np.arange(len(term)), many)
        at = self.start[term][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
        return np.bincount(self.query[at] * rows + row[entry], weights=weight[entry], minlength=self.n * rows).reshape(self.n, rows)
