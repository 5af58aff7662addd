"""Exact deduplication with counting quotient filters (operator 3).

Every partition builds filters from its documents' 64-bit fingerprints. A
filter covers one range of the hash space: its fingerprints share their leading
bits, the next bits (quotient) are the home slot, kept as an `occupied` and a
`run end` bitmap, the low bits (remainder) are stored in the order of their
slots, which sorts them; counts above one are kept beside their slot. Leading
bits, quotient and remainder give the whole fingerprint back, so filters merge
without loss by merging their sorted remainders.

Filters travel twice. The first time they cover coarse ranges, so a task sends
few of them; merged, they are cut into the fine ranges that one task can hold.
The number of coarse ranges is the square root of that of fine ones: neither
step has more filters than its input has megabytes.

Fingerprints whose merged count is above one route their documents to
verification by bytes. The others are single: where the list of repeated
fingerprints is small enough to be broadcast (Catalyst knows its size), their
texts don't move at all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, fresh, stored

#: Fingerprints that a fine range holds on average, and that a task sorts at once.
RANGE, RUN = 1 << 20, 1 << 22


class QuotientFilter:
    """Counting quotient filter over uint64 fingerprints, in its packed form."""

    head = "<BBQIQ"

    @staticmethod
    def build(fp: np.ndarray, count: np.ndarray | None = None, lead: int = 0) -> bytes:
        """Pack fingerprints (any order, repeats add up) with `lead` equal
        leading bits."""
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        count = np.ones(len(fp), np.uint64) if count is None else count[order]
        if len(fp):
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            fp, count = fp[first], np.add.reduceat(count, first)
        return QuotientFilter.pack(fp, count, lead)

    @staticmethod
    def pack(fp: np.ndarray, count: np.ndarray, lead: int = 0) -> bytes:
        """Pack sorted, distinct fingerprints."""
        n = len(fp)
        # slots for a load of three quarters
        q = min(max(1, int(np.ceil(np.log2(max(n, 1) / 0.75 + 1)))), 63 - lead)
        r = 64 - lead - q
        prefix = int(fp[0]) >> (64 - lead) if n and lead else 0
        home = ((fp << np.uint64(lead)) >> np.uint64(64 - q)).astype(np.int64)
        rest = fp & np.uint64((1 << r) - 1)
        occupied = np.zeros(1 << q, bool)
        occupied[home] = True
        run_end = np.ones(n, bool)
        run_end[:-1] = home[1:] != home[:-1]
        more = np.flatnonzero(count > 1)
        width = (r + 7) // 8
        packed = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()
        return struct.pack(QuotientFilter.head, lead, q, prefix, n, len(more)) + np.packbits(occupied).tobytes() + np.packbits(run_end).tobytes() + packed + more.astype("<u4").tobytes() + count[more].astype("<u8").tobytes()

    @staticmethod
    def read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        lead, q, prefix, n, m = struct.unpack_from(QuotientFilter.head, blob)
        at, r = struct.calcsize(QuotientFilter.head), 64 - lead - q

        def take(size: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(blob, np.uint8, size, at)
            at += size
            return part

        occupied = np.unpackbits(take(max(1, (1 << q) // 8)), count=1 << q)
        run_end = np.unpackbits(take((n + 7) // 8), count=n)
        width = (r + 7) // 8
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = take(n * width).reshape(n, width)
        run = np.zeros(n, np.int64)
        if n:
            run[1:] = np.cumsum(run_end[:-1])
        home = np.flatnonzero(occupied)[run] if n else np.zeros(0, np.int64)
        count = np.ones(n, np.uint64)
        more = take(4 * m).view("<u4")
        count[more] = take(8 * m).view("<u8")
        top = np.uint64(prefix << (64 - lead) if lead else 0)
        return top | (home.astype(np.uint64) << np.uint64(r)) | rest.view("<u8").ravel(), count

    @staticmethod
    def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and summed counts of several filters: sorted runs are
        merged two by two until one is left."""
        runs = [QuotientFilter.read(b) for b in blobs] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        while len(runs) > 1:
            pairs = zip(runs[::2], runs[1::2])
            runs = [_merged(*x, *y) for x, y in pairs] + ([runs[-1]] if len(runs) % 2 else [])
        return runs[0]

    @staticmethod
    def merge(blobs: list[bytes], lead: int = 0) -> bytes:
        """One filter of all, without loss."""
        return QuotientFilter.pack(*QuotientFilter.merged(blobs), lead)


def _merged(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge two sorted runs of distinct values with counts."""
    if len(a) < len(b):
        a, m, b, n = b, n, a, m
    if not len(b):
        return a, m
    at = np.searchsorted(a, b)
    same = a[np.minimum(at, len(a) - 1)] == b
    m = m.copy()
    m[at[same]] += n[same]
    new = ~same
    return np.insert(a, at[new], b[new]), np.insert(m, at[new], n[new])


def hash_range(fp: np.ndarray, n: int) -> np.ndarray:
    """The hash range, out of n equal ones, of each uint64."""
    return (((fp >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _filters(fp: np.ndarray, count: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """Sorted, distinct fingerprints as one filter for each value of their
    leading bits."""
    where = (fp >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(fp) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(fp)]
    return where[cut].tolist(), [QuotientFilter.pack(fp[a:b], count[a:b], bits) for a, b in zip(cut.tolist(), ends)]


def repeated_fingerprints(fingerprints: DataFrame, rows: int | None = None) -> DataFrame:
    """Fingerprints (one bigint column) that occur more than once: (fp). `rows`
    is about how many there are; they are counted where it is not given."""
    rows = fingerprints.count() if rows is None else rows
    partitions = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = max(rows // RANGE, partitions, 1).bit_length()
    coarse = (fine + 1) // 2
    spread = 1 << (fine - coarse)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, turn = [], 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            fp, count = np.unique(np.concatenate(held), return_counts=True)
            where, filters = _filters(fp, count.astype(np.uint64), coarse)
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([turn % spread] * len(where), pa.int32()), pa.array(filters, pa.binary())], ["coarse", "share", "filter"])

        for b in batches:
            held.append(np.asarray(b.column(0)).astype(np.int64).view(np.uint64))
            size += len(b)
            if size >= RUN:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def cut(table: pa.Table) -> pa.Table:
        where, filters = _filters(*QuotientFilter.merged(table.column("filter").to_pylist()), fine)
        return pa.table({"bucket": pa.array(where, pa.int32()), "filter": pa.array(filters, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        fp, n = QuotientFilter.merged(table.column("filter").to_pylist())
        return pa.table({"fp": pa.array(fp[n > 1].view(np.int64))})

    filters = fingerprints.mapInArrow(build, "coarse int, share int, filter binary")
    return filters.groupBy("coarse", "share").applyInArrow(cut, "bucket int, filter binary").groupBy("bucket").applyInArrow(count, "fp bigint")


def _flagged(docs: DataFrame, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """docs with three more columns, called as given: the smallest id among
    equal texts, their number, and whether the row is the one that stays."""
    keep, copies, kept = names
    fp, twice = fresh(docs, "fp", "twice")
    text, key = column(text_col), column(id_col)
    alone = {keep: key, copies: F.lit(1).cast("long"), kept: F.lit(True)}
    present = docs.where(text.isNotNull()).withColumn(fp, F.xxhash64(text))
    repeated = stored(repeated_fingerprints(present.select(fp), docs.count()), "repeated").select(F.col("fp").alias(fp), F.lit(True).alias(twice))
    # broadcast by Catalyst while its size allows, else one shuffle for both branches
    routed = present.join(repeated, fp, "left")
    group = Window.partitionBy(fp, text_col)
    columns = [*map(column, docs.columns), *names]
    several = routed.where(F.col(twice)).withColumns(
        {
            keep: F.min(key).over(group),
            copies: F.count(F.lit(1)).over(group),
            kept: F.row_number().over(group.orderBy(key.asc_nulls_last())) == 1,
        }
    )
    single = routed.where(F.col(twice).isNull()).withColumns(alone)
    absent = docs.where(text.isNull()).withColumns(alone)
    return several.select(*columns).unionByName(single.select(*columns)).unionByName(absent.select(*columns))


def flag_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `keep_id` (smallest id among equal texts), `copies` and
    `is_kept` (exactly one row of each text).

    Texts are equal byte by byte, whatever their length; empty texts are equal
    to each other. A null text is nobody's copy: it is kept, with copies = 1.
    Null ids sort last, so a text is represented by a null id only if all its
    rows have one. Of rows tied in text and id (repeated rows) one is kept. Other
    columns pass through untouched; columns called keep_id, copies or is_kept
    are replaced. An empty table gives an empty table.
    """
    names = ["keep_id", "copies", "is_kept"]
    return _flagged(docs.drop(*names), id_col, text_col, names)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, all columns as given, whatever their names; which
    row, and what nulls, empty and long texts, ties and empty tables give, is
    as in flag_exact."""
    names = fresh(docs, "keep_id", "copies", "is_kept")
    return _flagged(docs, id_col, text_col, names).where(F.col(names[2])).select(*map(column, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return flag_exact(docs).select("doc_id", "keep_id", "copies", "is_kept")


SQL = """
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text) AS keep_id,
       count(*) OVER (PARTITION BY text) AS copies,
       row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS is_kept
FROM documents WHERE text IS NOT NULL
UNION ALL
SELECT doc_id, doc_id, 1, true FROM documents WHERE text IS NULL
"""
