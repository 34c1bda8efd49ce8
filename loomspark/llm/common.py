"""What the training-data operators share: reading tables, the shared folder, n-gram hashing and linear models."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.shared import spread  # noqa: F401 - the operators take it from here

_CODE_SPACE = 0x110000
_GOLDEN = np.uint32(2654435769)
_PRIME = np.uint32(16777619)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Only where that is unset and all runs on this machine
    (tests) one is made and set; on a cluster it is an error, as executors don't share a folder of one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def short_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows in an Arrow batch than by default, since texts can be long; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that a lost executor never forces its recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables written by materialize once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, keys: Iterable[str], limit: int, seed: int) -> DataFrame:
    """At most limit rows, those of the smallest keyed hash: repeatable, and independent of partitioning."""
    hashed = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    return df.orderBy(hashed, *[F.col(k) for k in keys]).limit(limit)


# ---------------------------------------------------------------- text to numbers


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _word_table() -> np.ndarray:
    flags = np.zeros(_CODE_SPACE, bool)
    flags[: 0x30000] = [chr(i).isalnum() or i == 95 for i in range(0x30000)]
    return flags


_WORDS: np.ndarray | None = None


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words (runs of letters, digits and _) of the whole text, in order."""
    global _WORDS
    if _WORDS is None:
        _WORDS = _word_table()
    c = codepoints(text.lower())
    if not len(c):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(c) + 2, np.int8)
    inside[1:-1] = _WORDS[c]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(c))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * power[: len(c)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * inverse[start])


_POWERS: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, grown by doubling."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _POWERS = (both[0], both[1])
    return _POWERS


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class NGrams:
    """Distinct hashed character n-grams (lengths low..high) of whole texts, as binary features of 2**bits columns."""

    def __init__(self, low: int, high: int, bits: int, lower: bool = True):
        self.low, self.high, self.bits, self.lower = low, high, bits, lower
        self._slot: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slot": None}

    def distinct(self, text: str | None) -> np.ndarray:
        """Each present feature once; none for a null or empty text."""
        if not text:
            return np.zeros(0, np.int64)
        if self._slot is None:
            self._slot = np.zeros(1 << self.bits, np.int32)
        c = codepoints(text.lower() if self.lower else text) + np.uint32(1)
        shift = np.uint32(32 - self.bits)
        parts = []
        h = np.zeros(len(c), np.uint32)
        for n in range(1, min(self.high, len(c)) + 1):
            h = h[: len(c) - n + 1] * _PRIME + c[n - 1 :]
            if n >= self.low:
                x = (h ^ (h >> np.uint32(15))) * _GOLDEN
                parts.append((x ^ np.uint32((n * 0x85EBCA6B) & 0xFFFFFFFF)) * _GOLDEN >> shift)
        if not parts:
            return np.zeros(0, np.int64)
        ids = np.concatenate(parts).astype(np.int64)
        place = np.arange(len(ids), dtype=np.int32)
        self._slot[ids] = place
        return ids[self._slot[ids] == place]


class Rows:
    """Binary sparse rows over the features that at least min_df of them share."""

    def __init__(self, features: list[np.ndarray], columns: int, min_df: int = 1):
        length = np.array([len(f) for f in features], np.int64)
        flat = np.concatenate(features) if features else np.zeros(0, np.int32)
        df = np.bincount(flat, minlength=columns) if len(flat) else np.zeros(columns, np.int64)
        self.used = np.flatnonzero(df >= min_df)
        to = np.full(columns, -1, np.int32)
        to[self.used] = np.arange(len(self.used), dtype=np.int32)
        flat = to[flat]
        row = np.repeat(np.arange(len(features), dtype=np.int32), length)
        self.row, self.col = row[flat >= 0], flat[flat >= 0]
        self.n, self.columns = len(features), columns

    def keep(self, which: np.ndarray) -> None:
        """Drop the columns for which it is false."""
        to = np.cumsum(which) - 1
        mask = which[self.col]
        self.row, self.col, self.used = self.row[mask], to[self.col[mask]], self.used[which]

    def part(self, which: np.ndarray) -> Rows:
        """The rows for which it is true, over the same columns."""
        out = object.__new__(Rows)
        to, mask = np.cumsum(which) - 1, which[self.row]
        out.row, out.col, out.used, out.n, out.columns = to[self.row[mask]], self.col[mask], self.used, int(which.sum()), self.columns
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)[: self.n] if len(self.col) else np.zeros(self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=len(self.used)) if len(self.col) else np.zeros(len(self.used))

    def full(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.columns, np.float32)
        out[self.used] = w
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


def descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam on the full batch; the last coordinate is the bias."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
