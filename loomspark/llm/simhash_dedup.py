"""Near-duplicate documents by SimHash: all pairs of fingerprints within the radius, then connected components.

A fingerprint has 128 bits, over the set of lower-cased words of the whole text, so that most copies with one
word in twelve changed stay within the radius and unrelated texts far outside it. Equal fingerprints are linked first and
compared once. The others are dealt to blocks by hash, and every pair of blocks is compared by one task, so that no pair of
fingerprints is left out at any size of the table. Inside a task fingerprints are found by pigeonholes: if d bits of 128
differ, then some chunk of them differs in few, so only those are compared whose chunk is that near. This is exact: chunks
and blocks decide what the search costs, never what it finds. Each task gives a spanning forest of its matches instead of
all pairs, so that a group of n copies costs n rows a task and not n squared.

With SimHashParams(sampled=True), for corpora whose pairs of blocks are too many to compare, fingerprints only meet in
BK-trees over shards that agree in sampled bits, each in as many shards as the recall wanted of a pair at the radius itself
takes. A shard that would be hot is divided by further sampled bits. Then which pairs are found does depend on the number
of fingerprints; no query does this."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, spread, table, word_hashes

BITS = 128


@dataclass(frozen=True)
class SimHashParams:
    radius: int = 22
    #: Fingerprints of a block at most, on average; a task holds two blocks.
    block_rows: int = 1_000_000
    #: Find most pairs within the radius instead of all. What follows, but for the seed, is for this alone.
    sampled: bool = False
    #: Bits of a shard's key. None: those that cost least for the number of fingerprints.
    key_bits: int | None = None
    #: The recall of a pair at the radius; nearer pairs have a higher one.
    target_recall: float = 0.95
    #: What a row of a shard costs in the shuffle, in comparisons.
    row_cost: float = 200.0
    #: A shard expected to be larger is divided, seen on a sample of about so many fingerprints, up to twice.
    hot_rows: int = 65_536
    hot_sample: int = 20_000
    seed: int = 5

    def blocks(self, n: int) -> int:
        """Blocks for n fingerprints: up to 8 so that there are tasks enough for the cores, more where they would be too large."""
        return max(1, min(8, -(-n // 20_000)), -(-n // self.block_rows))

    def fitted(self, n: int) -> SimHashParams:
        """With the key bits for n fingerprints: the least of tables * (row_cost + fingerprints in a shard)."""
        if self.key_bits is not None:
            return self
        cost = lambda k: replace(self, key_bits=k).tables * (self.row_cost + n / 2**k)
        return replace(self, key_bits=min(range(6, 41), key=cost))

    @property
    def tables(self) -> int:
        hit = math.exp(sum(math.log((BITS - self.radius - i) / (BITS - i)) for i in range(self.key_bits or 14)))
        return math.ceil(math.log(1 - self.target_recall) / math.log(1 - hit))

    def positions(self) -> np.ndarray:
        rng = np.random.default_rng([self.seed, self.key_bits or 14])
        return np.array([rng.permutation(BITS)[: self.key_bits or 14] for _ in range(self.tables)])


def fingerprint(text: str | None) -> tuple[int, int, int] | None:
    """(high, low, words): the SimHash of the distinct words as two signed 64-bit halves, and a hash of the sequence of
    words. None where the text is null or has no word."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return None
    distinct = np.unique(words)
    both = np.empty((len(distinct), 2), np.uint64)
    both[:, 0] = distinct
    both[:, 1] = _second(distinct)
    votes = np.unpackbits(both.view(np.uint8), axis=1).sum(0, dtype=np.int64) * 2
    halves = np.packbits(votes > len(distinct)).view(np.int64)
    place = np.arange(1, 2 * len(words), 2, dtype=np.uint64)
    order = _second(words + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(halves[0]), int(halves[1]), int(order.astype(np.int64))


def _second(h: np.ndarray) -> np.ndarray:
    h = (h ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x8EBC6AF09C88C6E3)
    return h ^ (h >> np.uint64(29))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class BKForest:
    """A BK-tree for each run of equal keys. A child hangs on its parent by their integer Hamming distance; a search
    follows only the edges within radius of the query's distance to the node."""

    def __init__(self, key: np.ndarray, prints: np.ndarray):
        n = len(key)
        self.prints = prints
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
        self.root = first[np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1] if n else np.zeros(0, np.int64)
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[rest]
        slots, nodes = [], []
        while len(rest):  # one level of all trees at a time
            slot = at * (BITS + 1) + distance(prints[rest], prints[at])
            slot_of, where, inverse = np.unique(slot, return_index=True, return_inverse=True)
            child = rest[where]
            slots.append(slot_of)
            nodes.append(child)
            stay = np.ones(len(rest), bool)
            stay[where] = False
            at, rest = child[inverse][stay], rest[stay]
        slots_all = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        nodes_all = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(slots_all, kind="stable")
        self.slot, self.node = slots_all[order], nodes_all[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) within radius, of each query in its own tree."""
        q, node = queries, self.root[queries]
        found_q, found_n = [], []
        while len(q):
            d = distance(self.prints[q], self.prints[node])
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.slot, node * (BITS + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(self.slot, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            many = high - low
            q = np.repeat(q, many)
            offset = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
            node = self.node[np.repeat(low, many) + offset]
        return np.concatenate(found_q) if found_q else queries[:0], np.concatenate(found_n) if found_n else queries[:0]


def _forest_edges(key: np.ndarray, prints: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the matches inside each shard: (id, smallest id of its part of the shard)."""
    tree = BKForest(key, prints)
    size = np.bincount(tree.root, minlength=len(key))[tree.root]
    label = np.arange(len(key))
    # queries go through in runs whose frontier stays within memory, whatever the sizes of the shards
    cut = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), 1_000_000), side="left")
    for a, b in zip(cut, np.r_[cut[1:], len(key)]):
        q, n = tree.search(np.arange(a, b), radius)
        keep = q > n
        q, n = q[keep], n[keep]
        while len(q):  # hooking to the smaller root, and shortening of paths
            u, v = label[q], label[n]
            if (u == v).all():
                break
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
            while (label != label[label]).any():
                label = label[label]
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    joined = least[label] != ids
    return ids[joined], least[label][joined]


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, high, low) for every row with a non-null id whose text has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p[0], p[1]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := fingerprint(t))]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "high", "low"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return spread(slim).mapInArrow(run, "doc_id bigint, high bigint, low bigint")


def keys(bits: np.ndarray, params: SimHashParams) -> Iterator[np.ndarray]:
    """For each table the shard of each row of bits (n x BITS)."""
    k = params.key_bits or 14
    weight = np.int64(1) << np.arange(k, dtype=np.int64)
    for t, chosen in enumerate(params.positions()):
        yield bits[:, chosen].astype(np.int64) @ weight + (np.int64(t) << k)


def _bits(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([high, low], 1).view(np.uint8), axis=1)


def _hot(prints: DataFrame, n: int, params: SimHashParams) -> dict[int, int]:
    """Expected rows of the shards that a bounded sample shows to hold more than hot_rows."""
    if n <= params.hot_rows:
        return {}
    share = max(1, n // params.hot_sample)  # by hash, so that each task sends its part of the sample and no more
    rows = prints.where(F.pmod(F.xxhash64(F.lit(params.seed), "high", "low"), F.lit(share)) == 0).select("high", "low").toPandas()
    bits, out = _bits(rows["high"].to_numpy(), rows["low"].to_numpy()), {}
    for key in keys(bits, params):
        value, count = np.unique(key, return_counts=True)
        hot = count >= max(8, params.hot_rows * len(rows) / n)
        out |= {int(v): int(c * n / len(rows)) for v, c in zip(value[hot], count[hot])}
    return out


def _keyed(params: SimHashParams, hot: dict[int, int]):
    """A row for each shard of a fingerprint; of a hot shard one for each of the shards into which that is divided."""
    marked = np.array(sorted(hot), np.int64)
    inner = {v: replace(params, key_bits=None, seed=params.seed + 1).fitted(n) for v, n in hot.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda *cols: pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "id", "high", "low"])
        for batch in batches:
            ids, high, low = (batch.column(k).to_numpy() for k in range(3))
            bits = _bits(high, low)
            for key in keys(bits, params):
                warm = np.isin(key, marked)
                yield out(key[~warm], ids[~warm], high[~warm], low[~warm])
                for value in np.unique(key[warm]):
                    own = np.flatnonzero(key == value)
                    for sub in keys(bits[own], inner[int(value)]):
                        # keys below 0, of their own: two that met by chance would only share a tree
                        mixed = mix64(mix64(np.full(len(own), value).view(np.uint64)) + sub.view(np.uint64)) | np.uint64(1 << 63)
                        yield out(mixed.view(np.int64), ids[own], high[own], low[own])

    return run


def _search(params: SimHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, ids, high, low = (np.concatenate([p[k] for p in parts]) for k in range(4))
            same = np.r_[False, key[1:] == key[:-1], False]
            paired = same[:-1] | same[1:]
            a, b = _forest_edges(key[paired], np.stack([high, low], 1).view(np.uint64)[paired], ids[paired], params.radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:  # sorted by key; a run of equal keys may go on in the next batch
            cols = [batch.column(k).to_numpy() for k in range(4)]
            if not len(cols[0]):
                continue
            held.append(cols)
            rows += len(cols[0])
            if rows < 200_000:
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut == 0:
                continue
            held[-1] = [c[:cut] for c in cols]
            yield out(held)
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if held:
            yield out(held)

    return run


def chunks(k: int, radius: int) -> list[tuple[int, int, int]]:
    """(bits below, bits, radius) of k chunks of 64 bits: two halves within the radius have a chunk within its own."""
    (width, wider), (share, more), out, end = divmod(64, k), divmod(radius + 1, k), [], 64
    for i in range(k):
        end -= width + (i < wider)
        if share + (i < more):
            out.append((end, width + (i < wider), share + (i < more) - 1))
    return out


def _best(a: int, b: int, radius: int) -> int:
    """The number of chunks that costs least for a x b halves: in seconds, a call for each value, a step for each value near it, a comparison."""

    def cost(k: int) -> float:
        total = 0.0
        for _, width, r in chunks(k, radius):
            ball, cells = sum(math.comb(width, j) for j in range(r + 1)), 2.0**width
            total += min(cells, a) * (1e-5 + ball * (2e-8 + 6e-9 * b / cells)) + a * b * ball / cells * 2.5e-9 + cells * 1e-8
        return total

    return min(range(3, 17), key=cost)


class Links:
    """Connected components of the rows 0..n-1 as their links come in."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._rows = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self._held.append((u, v))
        self._rows += len(u)
        if self._rows > 500_000:
            self.settle()

    def settle(self) -> np.ndarray:
        """The smallest row of each row's component."""
        if self._held:
            q, n = (np.concatenate(x) for x in zip(*self._held))
            self._held, self._rows = [], 0
            while True:  # hooking to the smaller root, and shortening of paths
                u, v = self.label[q], self.label[n]
                open_ = u != v
                if not open_.any():
                    break
                q, n, u, v = q[open_], n[open_], u[open_], v[open_]
                np.minimum.at(self.label, np.maximum(u, v), np.minimum(u, v))
                while (self.label != (up := self.label[self.label])).any():
                    self.label = up
        return self.label


class Near:
    """Links all rows of prints (n x 2) whose distance is within the radius, one of them in rows, one in others (both
    sorted; the same rows or none in common)."""

    #: Comparisons made at once, and those of one cell from which on it is first seen what is linked already.
    STEP, HOT = 32_768, 1 << 22

    def __init__(self, prints: np.ndarray, radius: int, links: Links):
        self.prints, self.radius, self.links = prints, radius, links
        self._x, self._d, self._hit = np.empty(self.STEP, np.uint64), np.empty(self.STEP, np.uint8), np.empty(self.STEP, bool)

    def search(self, rows: np.ndarray, others: np.ndarray, k: int | None = None) -> None:
        low = (self.radius - 1) // 2  # one half is within radius // 2, or the other within this
        for half, radius in ((0, self.radius // 2), (1, low)):
            if radius < 0 or not len(rows) or not len(others):
                continue
            own = np.ascontiguousarray(self.prints[:, half])
            for at, width, r in chunks(k or _best(len(rows), len(others), radius), radius):
                self._chunk(own, radius, rows, others, at, width, r)

    def _chunk(self, half: np.ndarray, radius: int, rows: np.ndarray, others: np.ndarray, at: int, width: int, r: int) -> None:
        def sorted_(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            value = (half[some] >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32)
            order = np.argsort(value, kind="stable")
            return value[order], some[order]

        value, rows = sorted_(rows)
        there, others = sorted_(others)
        first = np.concatenate([[0], np.cumsum(np.bincount(there, minlength=1 << width))])
        left, right = half[rows], half[others]
        begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        end = np.r_[begin[1:], len(rows)]
        flips = np.array([sum(1 << x for x in c) for j in range(r + 1) for c in combinations(range(width), j)], np.int64)
        many = max(1, int(200_000 / (len(flips) * max(1.0, len(others) / (1 << width)))))
        for c in range(0, len(begin), many):
            near = value[begin[c : c + many], None].astype(np.int64) ^ flips
            size = first[near + 1] - first[near]
            stop = np.cumsum(size.sum(1))
            flat = size.ravel()
            place = np.repeat(first[near].ravel() - (np.cumsum(flat) - flat), flat) + np.arange(stop[-1])
            met, start = right[place], 0
            for p, q, to in zip(begin[c : c + many].tolist(), end[c : c + many].tolist(), stop.tolist()):
                if (q - p) * (to - start) > self.HOT:
                    self._hot(half, radius, rows[p:q], others[place[start:to]])
                elif to > start:
                    self._dense(left[p:q], met[start:to], radius, rows[p:q], others, place[start:to])
                start = to

    def _dense(self, a: np.ndarray, b: np.ndarray, radius: int, rows: np.ndarray, others: np.ndarray, place: np.ndarray) -> None:
        """All of a with all of b: first by their halves, then those near by both."""
        high = max(1, min(len(a), self.STEP // min(len(b), 2048)))
        wide = min(len(b), self.STEP // high)
        for i in range(0, len(a), high):
            for j in range(0, len(b), wide):
                x, y = a[i : i + high, None], b[j : j + wide]
                shape, n = (len(x), len(y)), len(x) * len(y)
                xor, d, hit = self._x[:n].reshape(shape), self._d[:n].reshape(shape), self._hit[:n].reshape(shape)
                np.bitwise_xor(x, y, out=xor)
                np.bitwise_count(xor, out=d)
                np.less_equal(d, radius, out=hit)
                if hit.any():
                    u, v = np.divmod(np.flatnonzero(hit), len(y))
                    u, v = rows[i + u], others[place[j + v]]
                    near = (u != v) & (distance(self.prints[u], self.prints[v]) <= self.radius)
                    if near.any():
                        self.links.add(u[near], v[near])

    def _hot(self, half: np.ndarray, radius: int, rows: np.ndarray, others: np.ndarray) -> None:
        """The same for many rows: what is linked already, or through a few rows in the middle, isn't compared again."""
        dense = lambda a, b: self._dense(half[a], half[b], radius, a, b, np.arange(len(b))) if len(a) and len(b) else None
        rest = rows
        for _ in range(8):
            for some in (rows, others):
                near = some[distance(self.prints[some], self.prints[rest[0]]) <= self.radius]
                self.links.add(np.full(len(near), rest[0]), near)
            label = self.links.settle()
            value, count = np.unique(label[rows], return_counts=True)
            largest = value[count.argmax()]
            rest = rows[label[rows] != largest]
            if not len(rest):
                break
        dense(rows[label[rows] == largest], others[label[others] != largest])
        dense(rest, others)


def _dealt(blocks: int):
    """Fingerprints by the block of their hash, packed, for each pair of blocks (a, b), a <= b, that theirs is one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(held)
            block = mix64(rows[:, 1].view(np.uint64) ^ mix64(np.ascontiguousarray(rows[:, 2]).view(np.uint64))) % np.uint64(blocks)
            pair, side, packed = [], [], []
            for c in range(blocks):
                own = rows[block == c]
                for some in (own[i : i + 1024].tobytes() for i in range(0, len(own), 1024)):
                    for other in range(blocks):
                        a, b = min(c, other), max(c, other)
                        pair.append(b * (b + 1) // 2 + a)
                        side.append(int(c != a))
                        packed.append(some)
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(side, pa.int32()), pa.array(packed, pa.binary())], ["pair", "side", "rows"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(3)], 1))
            if sum(map(len, held)) >= 1024 * blocks:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return run


def _compared(params: SimHashParams):
    """(id, smallest id of its part of the pair of blocks) for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in batches:
            for pair, side, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.setdefault(pair, ([], []))[side].append(packed)
        for pair in sorted(held):
            both = [np.frombuffer(b"".join(x), np.int64).reshape(-1, 3) for x in held.pop(pair)]
            rows = np.concatenate(both)
            links, at = Links(len(rows)), np.arange(len(rows))
            a, b = at[: len(both[0])], at[len(both[0]) :]
            alone = math.isqrt(8 * pair + 9) ** 2 == 8 * pair + 9  # one block with itself
            Near(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), params.radius, links).search(a, a if alone else b)
            label, least = links.settle(), np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, label, rows[:, 0])
            joined = least[label] != rows[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(rows[joined, 0]), pa.array(least[label][joined])], ["a", "b"])

    return run


def _all_links(first: DataFrame, n: int, params: SimHashParams) -> DataFrame:
    """(a, b): a spanning forest of all pairs of first (id, high, low; distinct fingerprints) within the radius."""
    blocks = params.blocks(n)
    dealt = first.mapInArrow(_dealt(blocks), "pair int, side int, rows binary")
    return dealt.repartitionById(blocks * (blocks + 1) // 2, "pair").mapInArrow(_compared(params), "a bigint, b bigint")


def _sampled_links(first: DataFrame, n: int, params: SimHashParams) -> DataFrame:
    """(a, b): links of first within the radius, those whose fingerprints agree in some key's sampled bits."""
    params = params.fitted(n)
    keyed = first.mapInArrow(_keyed(params, _hot(first, n, params)), "key bigint, id bigint, high bigint, low bigint")
    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_search(params), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, group): the smallest id connected to each id of the edges (a, b), by alternating large and small stars,
    each round written to the shared folder. Self-edges and repeats are harmless."""
    now = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: of each node, its smaller neighbours and itself go to the smallest
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = materialize(small, "edges")
        same = _content(after) == _content(now)
        discard(now)
        now = after
        if same:
            return now.select(F.col("a").alias("id"), F.col("b").alias("group"))


def _content(edges: DataFrame) -> tuple:
    """What distinct edges have alike only if they are the same, but for chance in 128 bits."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(3), "b", "a"))).first())


def groups(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, group_id) for each distinct non-null doc_id of docs: group_id is the smallest doc_id linked to it by
    fingerprints within the radius, the same words in any order included; every such link counts, unless params are sampled.

    Null and wordless texts are a group of their own each. A doc_id with several rows joins what any of its texts
    joins. Whole texts count, however long. Other columns are ignored. Empty tables give an empty result."""
    prints = materialize(_fingerprints(docs), "prints")
    first = materialize(prints.groupBy("high", "low").agg(F.min("doc_id").alias("id")).select("id", "high", "low"), "distinct")
    copies = prints.join(first, ["high", "low"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    n = first.count()
    near = (_sampled_links if params.sampled else _all_links)(first, n, params)
    found = components(copies.unionByName(near))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return ids.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("group", "doc_id").alias("group_id"))


def _ordered(docs: DataFrame) -> list[Column]:
    """The columns of docs but text, as something that can be ordered: maps and their like as JSON."""
    own = [(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType.simpleString()) for f in docs.schema if f.name != "text"]
    return [F.to_json(F.struct(c)) if any(x in kind for x in ("map<", "variant", "interval")) else c for c, kind in own]


def deduplicate(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """The rows of docs, columns as they are, with one row of each group: that of the smallest doc_id, and of its rows
    the one whose text is smallest, a doc_id being one document whatever its rows say; where texts are alike the other columns
    decide in their order, never how the table lies. Rows with a null doc_id stay. Columns may have any name. An empty table
    gives an empty one."""
    kept, place = (f"_{x}_{uuid.uuid4().hex}" for x in ("kept", "row"))
    ids = materialize(groups(docs, params).where("doc_id = group_id").select(F.col("doc_id").alias(kept)), "kept")
    # one shuffle of the texts by doc_id serves both the join and the choice among repeated rows
    one = Window.partitionBy(kept).orderBy(F.col("text").asc_nulls_last(), *_ordered(docs))
    chosen = docs.join(ids, docs["doc_id"].cast("bigint") == ids[kept]).withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place, kept)
    return chosen.unionByName(docs.where("doc_id IS NULL"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id, keep): keep is true for the one document of its group that stays."""
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
ORACLE: dict[str, str] = {}
