"""Sizing, column helpers and the vectorised text kernels of this subpackage."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored

__all__ = ["discard", "stored"]


def buckets(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Hash ranges to spread df's keys over: grows with the size of the tables
    df reads, so that a range fits a task at any input size. The sum over the
    scans is used, as the planner's own estimate multiplies at every join;
    scans of unknown size (rows made by the driver) count for nothing.

    Beyond 60 GB ranges grow with the square root of the input, to 320 MB at
    100 TB, so that what a task sends to a range stays more than its header.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(s for s in sizes if s < 1 << 62)
    return max(n, size // max(bytes_each, 32 * math.isqrt(size)), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, for columns of our own beside it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def tokens(text: str | Column = "text") -> Column:
    """Token estimate: a quarter of the UTF-8 bytes, rounded up; null is 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.ceil(F.octet_length(c) / F.lit(4)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """Uniform in [0, 1) from 52 bits of an MD5, the same in every engine."""
    digest = F.md5(F.concat(key, F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_ODD2 = 0xD6E8FEB86659FD93
_INV2 = pow(_ODD2, -1, 1 << 64)
_ODD3 = 0xA0761D6478BD642F
_INV3 = pow(_ODD3, -1, 1 << 64)
_ODD4 = 0xE7037ED1A0B428DB
_INV4 = pow(_ODD4, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64, in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int, inverse: int) -> None:
        self.base, self.inverse, self.n = base, inverse, 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 20)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(self.n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def arrow_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: A 128-bit content key (an MD5) in NumPy.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def content_key(text: str | Column) -> Column:
    """The MD5 of a text as 16 bytes: the key of its content."""
    return F.unhex(F.md5(text))


def keys_of(column: pa.Array) -> np.ndarray:
    """A binary column of content keys as KEYs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), KEY) if len(column) else np.zeros(0, KEY)


def arrow_keys(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def pieces(data: np.ndarray, off: np.ndarray, target: int = 1 << 20):
    """Cut a batch between documents into pieces of about `target` bytes:
    (first document, bytes, offsets)."""
    a = 0
    while a < len(off) - 1:
        b = int(np.searchsorted(off, off[a] + target, "right")) - 1
        b = min(max(b, a + 1), len(off) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Whitespace-separated words of a piece, hashed without a Python loop.

    `start`/`end` are byte positions, `at` the word offsets of the documents
    and `hash` a 64-bit hash of each word; with `second`, `hash2` is another
    one with a code and a base of its own, so that both together tell apart what
    one can't. Only ASCII whitespace separates.
    """

    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    code = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    code2 = np.random.default_rng(20250107).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, second: bool = False) -> None:
        self.bytes, self.words = Powers(_ODD, _INV), Powers(_ODD2, _INV2)
        self.second = second
        if second:
            self.bytes2, self.words2 = Powers(_ODD3, _INV3), Powers(_ODD4, _INV4)

    def split(self, data: np.ndarray, off: np.ndarray) -> "Words":
        n = len(data)
        black = np.zeros(n + 2, bool)
        np.logical_not(self.space[data], out=black[1:-1])
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        self.start = np.flatnonzero(black[1:-1] & (~black[:-2] | cut[:-1]))
        self.end = np.flatnonzero(black[1:-1] & (~black[2:] | cut[1:])) + 1
        self.at = np.searchsorted(self.start, off)
        self.hash = self._hashed(data, self.code, self.bytes)
        if self.second:
            self.hash2 = self._hashed(data, self.code2, self.bytes2)
        return self

    def _hashed(self, data: np.ndarray, code: np.ndarray, powers: Powers) -> np.ndarray:
        n = len(data)
        up, down = powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code[data] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def windows(self, width: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (the second ones, if asked for) of all runs of `width` words
        and the index of their first word; no run crosses documents."""
        h, powers = (self.hash2, self.words2) if second else (self.hash, self.words)
        n = len(h)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        ok = np.ones(n - width + 1, bool)
        for b in np.unique(self.at[1:-1]):
            ok[max(0, b - width + 1) : b] = False
        i = np.flatnonzero(ok)
        return mix((total[i + width] - total[i]) * down[i]), i
