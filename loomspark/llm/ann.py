"""Approximate nearest neighbours by balanced posting lists: boundary vectors are replicated to several lists, centroids
are searched by an in-memory graph, and a distance-ratio rule selects the lists to scan, however many they are.

Vectors are dealt to cells by coarse centroids; a cell is cut, by bisection with bounded imbalance and a few rounds of
k-means, into lists of at most list_size. Two more rounds move the centroids to the means of
the vectors nearest to them among all cells. A vector then lies in the list of the nearest centroid, and, near a
boundary, in the next ones too. The ratio up to which lists are scanned is fitted on a bounded sample of the vectors,
whose exact neighbours among all rows are found by brute force: the least one that finds the wanted share of them.

The centroids of all lists and a neighbour graph over them are what a task holds in memory: their size is checked against
graph_bytes, beyond which the vectors are dealt by hash to as many indexes as keep each within it and every query
searches all of them. Lists are scanned where their cell lies: a query goes once to each cell that has a list it
selected. Equal vectors are indexed once, and their ids put back at the end, so copies can't crowd a list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, table


@dataclass(frozen=True)
class AnnParams:
    k: int = 10
    list_size: int = 64
    #: Lists that hold a vector besides the nearest, if their centroid is within closure times the nearest's distance.
    replicas: int = 2
    closure: float = 1.005
    #: Lists scanned: those whose centroid is within prune times the distance of the nearest. None: fitted to recall.
    prune: float | None = None
    #: The share of neighbours that the ratio has to find on the sample of `calibration` vectors.
    recall: float = 0.925
    calibration: int = 400
    #: Rounds of k-means within a cell, and over all cells.
    rounds: int = 6
    refine: int = 2
    #: Width at which a search of centroids begins; it grows until its last list lies outside prune.
    beam: int = 64
    degree: int = 16
    #: Vectors that a cell aims at: it is clustered, and its lists scanned, by one task.
    cell_rows: int = 4096
    #: Bound of the sample from which coarse centroids come, for each cell.
    sample_per_cell: int = 16
    graph_bytes: int = 64 << 20
    seed: int = 41


def normalised(vectors: list) -> list[bytes | None]:
    """float32 bytes of length one; None for null, empty, zero or not finite vectors."""
    out: list[bytes | None] = []
    for v in vectors:
        x = None if v is None or any(e is None for e in v) else np.asarray(v, np.float64)
        size = 0.0 if x is None or not len(x) else float(np.sqrt(x @ x))
        out.append((x / size).astype(np.float32).tobytes() if x is not None and np.isfinite(size) and size > 0 else None)
    return out


def bisect(x: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """The leaf of each row: two-means cuts, none leaving a side under three tenths, until no leaf is over most."""
    leaf = np.zeros(len(x), np.int64)
    todo, n = [np.arange(len(x))], 0
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            leaf[rows] = n
            n += 1
            continue
        own = x[rows]
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = own @ (b - a) > ((b * b).sum() - (a * a).sum()) / 2
            if side.all() or not side.any():
                break
            a, b = own[~side].mean(0), own[side].mean(0)
        along = own @ (b - a)
        order = np.argsort(along, kind="stable")
        at = int(np.clip((along <= ((b * b).sum() - (a * a).sum()) / 2).sum(), 0.3 * len(own), 0.7 * len(own)))
        at = min(max(at, 1), len(own) - 1)
        todo += [rows[order[:at]], rows[order[at:]]]
    return leaf


def means(x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    order = np.argsort(leaf, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(leaf[order]) > 0])
    return (np.add.reduceat(x[order].astype(np.float64), start) / np.diff(np.r_[start, len(x)])[:, None]).astype(np.float32)


def cluster(x: np.ndarray, most: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of lists of at most `most` rows: bisection, then k-means, after which what has grown over is cut again."""
    leaf = bisect(x, most, rng)
    for _ in range(rounds):
        c = means(x, leaf)
        near = np.concatenate([((c * c).sum(1) - 2 * (x[i : i + 1024] @ c.T)).argmin(1) for i in range(0, len(x), 1024)])
        _, leaf = np.unique(near, return_inverse=True)
    for one in np.flatnonzero(np.bincount(leaf) > most):
        own = np.flatnonzero(leaf == one)
        leaf[own] = leaf.max() + 1 + bisect(x[own], most, rng)
    return means(x, leaf)


class CentroidGraph:
    """Centroids with their neighbours; a search walks from the nearest pivots along edges, keeping the best beam."""

    def __init__(self, centroids: np.ndarray, neighbours: np.ndarray):
        self.c, self.nb = centroids, neighbours
        self.norm = (centroids * centroids).sum(1)
        k = len(centroids)
        self.pivots = np.unique(np.linspace(0, k - 1, min(k, max(64, 2 * int(np.sqrt(k))))).astype(np.int64))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), nearest first, for each row of q; at most beam of them, id -1 where there are fewer."""
        n, row = len(q), np.arange(len(q))[:, None]
        square = (q * q).sum(1)[:, None]
        d = self.norm[self.pivots] - 2 * (q @ self.c[self.pivots].T) + square
        take = min(beam, len(self.pivots))
        near = np.argpartition(d, take - 1, axis=1)[:, :take]
        ids, dist = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
        ids[:, :take], dist[:, :take] = self.pivots[near], d[row, near]
        done = ids < 0
        if len(self.pivots) == len(self.c):
            done[:] = True
        while not done.all():
            # four unexpanded entries of each beam at a time
            best = np.argsort(np.where(done, np.inf, dist), axis=1)[:, :4]
            fresh = ~done[row, best]
            done[row, best] = True
            active = np.flatnonzero(fresh.any(1))
            nb = np.where(fresh[active][:, :, None], self.nb[np.maximum(ids[active[:, None], best[active]], 0)], -1).reshape(len(active), -1)
            found = self.norm[nb] - 2 * np.einsum("ijk,ik->ij", self.c[nb], q[active]) + square[active]
            found[nb < 0] = np.inf
            all_ids, all_d = np.concatenate([ids[active], nb], 1), np.concatenate([dist[active], found], 1)
            all_done = np.concatenate([done[active], nb < 0], 1)
            order = np.argsort(all_ids, axis=1, kind="stable")  # an entry of the beam comes before its repetitions
            r = np.arange(len(active))[:, None]
            s = all_ids[r, order]
            again = np.zeros_like(s, bool)
            again[:, 1:] = s[:, 1:] == s[:, :-1]
            ds = np.where(again, np.inf, all_d[r, order])
            keep = np.argpartition(ds, beam - 1, axis=1)[:, :beam]
            dist[active], ids[active], done[active] = ds[r, keep], np.where(np.isfinite(ds[r, keep]), s[r, keep], -1), all_done[r, order][r, keep] | ~np.isfinite(ds[r, keep])
        order = np.argsort(dist, axis=1, kind="stable")
        return ids[row, order], np.sqrt(np.maximum(dist[row, order], 0))

    def within(self, q: np.ndarray, beam: int, prune: float) -> list[np.ndarray]:
        """For each row of q the lists within prune times the distance of the nearest: a beam whose last entry is still
        within is widened, and once walking costs more than looking at every centroid, all are looked at."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        todo = np.arange(len(q))
        while len(todo) and beam < len(self.c) and beam * beam < 16 * len(self.c):
            open_ = []
            step = max(1, (1 << 16) // beam)  # rows at a time, for memory
            for at in range(0, len(todo), step):
                rows = todo[at : at + step]
                ids, dist = self.search(q[rows], beam)
                near = (ids >= 0) & (dist <= prune * dist[:, :1] + 1e-6)
                for i, r in enumerate(rows):
                    out[r] = ids[i, near[i]]
                open_.append(rows[near[:, -1] | (ids[:, -1] < 0)])
            todo, beam = np.concatenate(open_), beam * 4
        step = max(1, (1 << 22) // len(self.c))
        for at in range(0, len(todo), step):
            rows = todo[at : at + step]
            square = self.norm - 2 * (q[rows] @ self.c.T) + (q[rows] * q[rows]).sum(1)[:, None]
            dist = np.sqrt(np.maximum(square, 0))
            near = dist <= prune * dist.min(1, keepdims=True) + 1e-6
            for i, r in enumerate(rows):
                out[r] = np.flatnonzero(near[i])
        return out

    def replicas(self, ids: np.ndarray, dist: np.ndarray, most: int, closure: float) -> np.ndarray:
        """Which found lists hold the vector: the nearest, and up to most others within closure of its distance."""
        place = np.arange(ids.shape[1])
        return (ids >= 0) & (place < most) & (dist <= closure * dist[:, :1])


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _cells(base: DataFrame, n: int, dim: int, params: AnnParams) -> DataFrame:
    """base with its cell; a crowded cell is divided by hash, so that none is over twice cell_rows or so."""
    many = -(-n // params.cell_rows)
    if many == 1:
        return base.withColumn("cell", F.lit(0).cast("bigint"))
    sample = bounded_sample(base.select("id", "v"), ["id"], params.sample_per_cell * many, params.seed).collect()
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in sorted(sample, key=lambda r: r["id"])])
    coarse = base.sparkSession.sparkContext.broadcast(means(x, bisect(x, -(-len(x) // many), np.random.default_rng(params.seed))))  # a vector for each cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coarse.value
        for b in batches:
            x = _floats(b.column(1), dim)
            near = np.concatenate([((c * c).sum(1) - 2 * (x[i : i + 1024] @ c.T)).argmin(1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int64())], ["id", "v", "cell"])

    dealt = materialize(base.mapInArrow(run, "id bigint, v binary, cell bigint"), "ann-dealt")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (2 * params.cell_rows)).cast("bigint").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(params.seed), "id"), F.col("parts"))
    return dealt.join(sizes, "cell").select("id", "v", (F.col("cell") * 1_000_000 + part).alias("cell"))


def _lists(celled: DataFrame, dim: int, params: AnnParams) -> DataFrame:
    """(cell, list, v): the centroids of the lists of each cell."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        cell = int(frame["cell"].iloc[0])
        c = cluster(np.frombuffer(b"".join(frame["v"]), np.float32).reshape(-1, dim), params.list_size, params.rounds, np.random.default_rng([params.seed, cell]))
        return pd.DataFrame({"cell": cell, "list": np.arange(len(c)), "v": [r.tobytes() for r in c]})

    return celled.groupBy("cell").applyInPandas(run, "cell bigint, list bigint, v binary")


def _graph(spark: SparkSession, centroids: np.ndarray, params: AnnParams) -> CentroidGraph:
    """The nearest degree / 2 of each centroid, found block by block on the executors, and as many edges back."""
    k, half = len(centroids), min(params.degree // 2, len(centroids) - 1)
    if half < 1:
        return CentroidGraph(centroids, np.full((k, 1), -1, np.int64))
    held = spark.sparkContext.broadcast(centroids)  # within graph_bytes
    step = 1024

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        norm = (c * c).sum(1)
        for batch in batches:
            for at in batch["id"]:
                rows = np.arange(at * step, min((at + 1) * step, len(c)))
                d = norm - 2 * (c[rows] @ c.T)
                d[np.arange(len(rows)), rows] = np.inf
                near = np.argpartition(d, half - 1, axis=1)[:, :half] if half < len(c) - 1 else np.argsort(d, axis=1)[:, :half]
                yield pd.DataFrame({"at": [int(at)], "near": [near.astype(np.int32).tobytes()]})

    blocks = spark.range(0, -(-k // step), 1, min(-(-k // step), 1024)).mapInPandas(run, "at bigint, near binary").collect()
    near = np.concatenate([np.frombuffer(r["near"], np.int32).reshape(-1, half) for r in sorted(blocks, key=lambda r: r["at"])]).astype(np.int64)
    back = np.full((k, params.degree - half), -1, np.int64)
    src, dst = np.repeat(np.arange(k), half), near.ravel()
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    fits = place < back.shape[1]
    back[dst[fits], place[fits]] = src[fits]
    return CentroidGraph(centroids, np.concatenate([near, back], 1))


def _scan(dim: int, k: int):
    def run(postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of each query in the lists of this cell that it selected."""
        if not len(postings) or not len(queries):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype="object"), "ds": pd.Series(dtype="object")})
        x = np.frombuffer(b"".join(postings["v"]), np.float32).reshape(-1, dim)
        y = np.frombuffer(b"".join(queries["v"]), np.float32).reshape(-1, dim)
        ids, qid = postings["id"].to_numpy(), queries["q"].to_numpy()
        lists = [np.frombuffer(b, np.int32) for b in queries["lists"]]
        owner, wanted = np.repeat(np.arange(len(lists)), [len(s) for s in lists]), np.concatenate(lists)
        order = np.argsort(wanted, kind="stable")
        owner, wanted = owner[order], wanted[order]
        by_list = np.argsort(postings["list"].to_numpy(), kind="stable")
        listed = postings["list"].to_numpy()[by_list]
        best_d, best_i = np.full((len(y), k), -np.inf), np.full((len(y), k), -1, np.int64)
        for value in np.unique(wanted):
            rows = by_list[np.searchsorted(listed, value) : np.searchsorted(listed, value, side="right")]
            asked = owner[np.searchsorted(wanted, value) : np.searchsorted(wanted, value, side="right")]
            for at in range(0, len(asked) if len(rows) else 0, 4096):
                qs = asked[at : at + 4096]
                s = (y[qs] @ x[rows].T).astype(np.float64)
                s[qid[qs][:, None] == ids[rows]] = -np.inf
                take = min(k, len(rows))
                near = np.argpartition(-s, take - 1, axis=1)[:, :take]
                r = np.arange(len(qs))[:, None]
                exact = np.einsum("ijk,ik->ij", x[rows][near].astype(np.float64), y[qs].astype(np.float64))
                d = np.concatenate([best_d[qs], np.where(np.isfinite(s[r, near]), np.round(exact, 6), -np.inf)], 1)
                i = np.concatenate([best_i[qs], ids[rows][near]], 1)
                by_id = np.argsort(i, axis=1, kind="stable")  # a vector that two lists hold counts once
                d, i = d[r, by_id], i[r, by_id]
                d[:, 1:][i[:, 1:] == i[:, :-1]] = -np.inf
                top = np.argsort(-d, axis=1, kind="stable")[:, :k]
                best_d[qs], best_i[qs] = d[r, top], np.where(np.isfinite(d[r, top]), i[r, top], -1)
        good = best_i >= 0
        some = good.any(1)
        kept = lambda best: pd.Series([b[g] for b, g in zip(best[some], good[some])], dtype="object")
        return pd.DataFrame({"q": qid[some], "ids": kept(best_i), "ds": kept(best_d)})

    return run


@dataclass
class Index:
    """Lists over `rows` vectors: postings (cell, list, id, v) in the shared folder, what tasks hold in memory, and prune."""

    postings: DataFrame
    held: Broadcast
    rows: int
    dim: int
    prune: float

    def routes(self, queries: DataFrame, params: AnnParams) -> DataFrame:
        """(cell, q, v, lists): each query once for each cell that has a list it selects."""
        held, dim, prune = self.held, self.dim, self.prune

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph, cells, names = held.value
            for b in batches:
                x = _floats(b.column(1), dim)
                rows, to, chosen = [], [], []
                for at in range(0, len(x), 1024):
                    for i, f in enumerate(graph.within(x[at : at + 1024], params.beam, prune)):
                        for c in np.unique(cells[f]):
                            rows.append(at + i)
                            to.append(c)
                            chosen.append(names[f[cells[f] == c]].tobytes())
                take = pa.array(np.array(rows, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(to, np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(chosen, pa.binary())], ["cell", "q", "v", "lists"])

        return queries.select("id", "v").mapInArrow(run, "cell bigint, q bigint, v binary, lists binary")

    def search(self, queries: DataFrame, params: AnnParams) -> DataFrame:
        """(q, ids, ds): for each query the nearest found in each cell."""
        return self.postings.groupBy("cell").cogroup(self.routes(queries, params).groupBy("cell")).applyInPandas(_scan(self.dim, params.k), "q bigint, ids array<bigint>, ds array<double>")


def _centred(index: DataFrame, held: Broadcast, dim: int) -> DataFrame:
    """(cell, list, v): each list's new centroid, the mean of the vectors nearest to the old one. A task passes on a sum for
    each list that it met."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, cells, names = held.value
        total, many = np.zeros((len(cells), dim)), np.zeros(len(cells), np.int64)
        for b in batches:
            x = _floats(b.column(1), dim)
            for at in range(0, len(x), 1024):
                near = graph.search(x[at : at + 1024], 8)[0][:, 0]
                np.add.at(total, near, x[at : at + 1024])
                many += np.bincount(near, minlength=len(cells))
        met = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(cells[met]), pa.array(names[met].astype(np.int64)), pa.array(many[met]), pa.array([r.tobytes() for r in total[met]], pa.binary())], ["cell", "list", "n", "s"])

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(frame["s"]), np.float64).reshape(-1, dim)
        order = np.argsort(frame["list"].to_numpy(), kind="stable")
        kept, start = np.unique(frame["list"].to_numpy()[order], return_index=True)
        c = np.add.reduceat(x[order], start) / np.add.reduceat(frame["n"].to_numpy()[order], start)[:, None]
        return pd.DataFrame({"cell": frame["cell"].iloc[0], "list": kept, "v": [r.tobytes() for r in c.astype(np.float32)]})

    part = index.select("id", "v").mapInArrow(sums, "cell bigint, list bigint, n bigint, s binary")
    return part.groupBy("cell").applyInPandas(mean, "cell bigint, list bigint, v binary")


def _build(index: DataFrame, n: int, dim: int, params: AnnParams) -> Index:
    spark = index.sparkSession
    lists = _lists(_cells(index, n, dim, params), dim, params)
    for k in range(params.refine + 1):
        heads = sorted(lists.collect(), key=lambda r: (r["cell"], r["list"]))  # within graph_bytes
        graph = _graph(spark, np.stack([np.frombuffer(r["v"], np.float32) for r in heads]), params)
        cells, names = np.array([r["cell"] for r in heads]), np.array([r["list"] for r in heads], np.int32)
        held = spark.sparkContext.broadcast((graph, cells, names))  # within graph_bytes and the edges
        if k < params.refine:
            lists = _centred(index, held, dim)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, cells, names = held.value
        for b in batches:
            x = _floats(b.column(1), dim)
            for at in range(0, len(x), 1024):
                found, dist = graph.search(x[at : at + 1024], min(params.beam, max(8, len(cells))))
                r, j = np.nonzero(graph.replicas(found, dist, params.replicas + 1, params.closure))
                c, rows = found[r, j], pa.array(r + at)
                yield pa.RecordBatch.from_arrays([pa.array(cells[c]), pa.array(names[c].astype(np.int64)), b.column(0).take(rows), b.column(1).take(rows)], ["cell", "list", "id", "v"])

    postings = materialize(index.select("id", "v").mapInArrow(copies, "cell bigint, list bigint, id bigint, v binary"), "ann-postings")
    prune = params.prune if params.prune is not None else _fit_prune(index, postings, graph, cells, names, dim, params)
    return Index(postings, held, n, dim, prune)


def _fit_prune(index: DataFrame, postings: DataFrame, graph: CentroidGraph, cells: np.ndarray, names: np.ndarray, dim: int, params: AnnParams) -> float:
    """The least ratio that finds the wanted share of the exact k nearest of a bounded sample, among all rows."""
    spark, k = index.sparkSession, params.k
    sample = sorted(bounded_sample(index.select("id", "v"), ["id"], params.calibration, params.seed + 1).collect(), key=lambda r: r["id"])
    y, asked = np.stack([np.frombuffer(r["v"], np.float32) for r in sample]), np.array([r["id"] for r in sample])
    held = spark.sparkContext.broadcast((y, asked))  # `calibration` vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, asked = held.value
        best_d, best_i = np.full((len(y), 0), -np.inf, np.float32), np.zeros((len(y), 0), np.int64)
        for b in batches:
            ids, x = b.column(0).to_numpy(), _floats(b.column(1), dim)
            for at in range(0, len(x), 4096):
                s = y @ x[at : at + 4096].T
                s[asked[:, None] == ids[at : at + 4096]] = -np.inf
                d, i = np.concatenate([best_d, s], 1), np.concatenate([best_i, np.broadcast_to(ids[at : at + 4096], s.shape)], 1)
                top = np.argpartition(-d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, top, 1), np.take_along_axis(i, top, 1)
        q, j = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_i[q, j]), pa.array(best_d[q, j].astype(np.float64))], ["q", "id", "d"])

    near = index.select("id", "v").mapInArrow(nearest, "q bigint, id bigint, d double")
    true = near.withColumn("p", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("d"), "id"))).where(F.col("p") <= k).select("q", "id")
    lie = true.join(postings.select("id", "cell", "list"), "id").collect()  # calibration * k * (replicas + 1) rows at most
    if not lie:
        return 1.0
    place = {(int(c), int(m)): i for i, (c, m) in enumerate(zip(cells, names))}
    least: dict[tuple[int, int], float] = {}
    distance = {q: np.sqrt(np.maximum(((graph.c - y[q]) ** 2).sum(1), 0)) for q in {r["q"] for r in lie}}
    for r in lie:
        d = distance[r["q"]]
        ratio = float(d[place[r["cell"], r["list"]]] / max(d.min(), 1e-9))
        least[r["q"], r["id"]] = min(ratio, least.get((r["q"], r["id"]), np.inf))
    return float(np.quantile(list(least.values()), params.recall, method="higher"))


def _once(vectors: DataFrame) -> DataFrame:
    """(id, v) of the vectors that take part, each id once."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(normalised(b.column(1).to_pylist()), pa.binary())], ["id", "v"])

    slim = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("e")).where("id IS NOT NULL AND e IS NOT NULL")
    return materialize(slim.mapInArrow(unit, "id bigint, v binary").where("v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")), "ann-unit")


def _indexes(base: DataFrame, dim: int, params: AnnParams) -> list[Index]:
    n = base.count()
    shards = -(-n * 3 * dim * 4 // (params.list_size * params.graph_bytes))  # lists are a third full at least
    out = []
    for s in range(shards):
        part = base if shards == 1 else base.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == s)
        size = n if shards == 1 else part.count()
        if size:
            out.append(_build(part, size, dim, params))
    return out


def profile(vectors: DataFrame, params: AnnParams = AnnParams(), every: int = 50) -> dict[str, float]:
    """What a search by the ids divisible by `every` scans: rows and the share of all rows for a query, lists, copies of a
    vector, the longest list and the ratio fitted. For vectors of one length without copies."""
    base = _once(vectors)
    dim = base.select(F.octet_length("v")).first()[0] // 4
    (index,) = _indexes(base, dim, params)
    sizes = {(r["cell"], r["list"]): r["count"] for r in index.postings.groupBy("cell", "list").count().collect()}
    asked = base.where(F.col("id") % every == 0)
    scanned = sum(sizes.get((r["cell"], int(m)), 0) for r in index.routes(asked, params).collect() for m in np.frombuffer(r["lists"], np.int32))
    each = scanned / max(asked.count(), 1)
    return {"scanned": each, "share": each / index.rows, "lists": len(sizes), "copies": sum(sizes.values()) / index.rows, "longest": max(sizes.values()), "prune": index.prune}


def neighbours(vectors: DataFrame, params: AnnParams = AnnParams(), every: int = 1) -> DataFrame:
    """(vec_id, neighbor_id, rank, similarity): for each vector whose id is divisible by `every` (1: for all) the k others
    of the largest cosine among all vectors, approximately.

    Rows with a null id, or with a null, empty, zero or not finite vector, neither ask nor are found; nor are vectors of
    another length than the most common (the smaller on a tie). An id that repeats counts once, by its smallest vector.
    Ties of similarity (rounded to six places) go by id. With fewer than k others all are found. Other columns are
    ignored; empty tables give an empty result."""

    spark, k = vectors.sparkSession, params.k
    once = _once(vectors)
    kinds = once.groupBy(F.octet_length("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    out = "vec_id bigint, neighbor_id bigint, rank int, similarity double"
    if not kinds:
        return spark.createDataFrame([], out)
    dim = kinds[0]["size"] // 4
    same = Window.partitionBy("v")
    # members of equal vectors: the first stands for all, and no answer needs more than the k + 1 smallest ids
    members = once.where(F.octet_length("v") == 4 * dim).withColumn("rep", F.min("id").over(same)).withColumn("rn", F.row_number().over(same.orderBy("id")))
    members = materialize(members, "ann-members")
    base = members.where("rn = 1").select("id", "v")
    asks = F.col("id") % every == 0
    asking = members.where(asks).select(F.col("rep").alias("id"), "v").distinct()  # a group asks if one of it does
    found = reduce(DataFrame.unionByName, [index.search(asking, params) for index in _indexes(base, dim, params)])
    pairs = F.arrays_zip(F.transform("ds", lambda d: -d).alias("d"), F.col("ids").alias("i"))
    ordered = found.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("all"))
    first = ordered.select("q", F.slice("all", 1, (params.replicas + 1) * k).alias("all"))
    # a vector found in two cells counts once: equal ids have equal similarity, so they are neighbours in the order
    once_each = F.filter("all", lambda x, i: (i == 0) | (F.get("all", F.greatest(i - 1, F.lit(0)))["i"] != x["i"]))
    top = materialize(first.select("q", F.slice(once_each, 1, k).alias("all")), "ann-top")
    if members.where("rn > 1").isEmpty():
        return top.select(F.col("q").alias("vec_id"), F.posexplode("all").alias("p", "x")).select("vec_id", F.col("x.i").alias("neighbor_id"), (F.col("p") + 1).alias("rank"), (-F.col("x.d")).alias("similarity"))
    # every member of a group asks: its own group at similarity 1, then the groups of the vectors found
    flat = top.select("q", F.explode("all").alias("x")).select("q", F.col("x.i").alias("rep"), (-F.col("x.d")).alias("similarity"))
    smallest = members.where(F.col("rn") <= k + 1).select("rep", F.col("id").alias("neighbor_id"))
    wide = flat.join(smallest, "rep").select(F.col("q").alias("rep"), "neighbor_id", "similarity")
    wide = wide.unionByName(smallest.select("rep", "neighbor_id", F.lit(1.0).alias("similarity")))
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbor_id")
    lists = wide.withColumn("p", F.row_number().over(best)).where(F.col("p") <= k + 1)
    asked = members.where(asks).select("rep", F.col("id").alias("vec_id")).join(lists, "rep").where("vec_id <> neighbor_id")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbor_id"))
    return asked.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "similarity")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all vectors, of each whose id is divisible by 50."""
    return neighbours(table(spark, sf_dir, "embeddings"), every=50)


QUERIES = {"op1_ann": op1_ann}
ORACLE: dict[str, str] = {}
