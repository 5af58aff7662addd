"""Best-fit packing by sums of squares (operator 8).

Documents are cut into pieces of at most CAPACITY tokens. A full piece fills a
bin alone. Every other piece goes where the sum, over residual gaps, of the
squared number of open bins with that gap becomes smallest (Csirik et al.),
a new bin being one of the choices; ties go to the smallest gap left. Packing is
sequential by nature, so documents are spread by hash over shards of about
SHARD_DOCS documents, each packed on its own in the order of another hash: the
result depends on the documents only, not on partitions, and shards keep one
size however large the input is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tokens

CAPACITY, SHARD_DOCS = 2048, 16_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each size (1..capacity), in the order given.
    Bins with one gap are used last-in, first-out."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    never = np.int64(1) << 60
    for i, s in enumerate(sizes.tolist()):
        # leaving gap g - s: one bin fewer at g, one more at g - s (closed bins, gap 0, don't count)
        change = 2 * (count[: capacity - s + 1] - count[s:]) + 2
        change[count[s:] == 0] = never
        if s <= capacity:
            if count[s]:
                change[0] = 1 - 2 * count[s]
            change[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 0
        left = int(np.argmin(change))
        gap = left + s
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


PLACES = "piece int, tokens bigint, shard int, bin bigint, bin_offset bigint"


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Rows (doc_id, piece, tokens, shard, bin, bin_offset): where each piece
    of each document goes; doc_id as given. Bins are numbered within their shard.

    Documents without tokens (null or empty text) take no room and have no row.
    Very long texts are cut into pieces of `capacity` and a rest. A null id is
    carried along as null (its text decides on the shard); rows with equal ids
    are packed one by one. Ties in the order are broken by id and size, so
    repeated rows are interchangeable. An empty table gives an empty table;
    extra columns, whatever their names, are ignored.
    """
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    sized = docs.select("doc_id", tokens().alias("n"), salt.alias("salt")).where("n > 0")
    shards = docs.groupBy().agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(shard_docs))).cast("int").alias("shards")).first()[0]
    spread = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "salt"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("n", "ascending")])
        ids, n = table.column("doc_id"), np.asarray(table.column("n"))
        full, rest = n // capacity, n % capacity
        part = np.flatnonzero(rest)
        bins, offsets = sum_of_squares(rest[part], capacity)
        first = int(bins.max()) + 1 if len(bins) else 0
        whole = np.repeat(np.arange(len(n)), full)
        number = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        owner = np.concatenate([part, whole])
        return pa.table(
            {
                "doc_id": ids.take(pa.array(owner)),
                "piece": pa.array(np.concatenate([full[part], number]), pa.int32()),
                "tokens": pa.array(np.concatenate([rest[part], np.full(len(whole), capacity)]), pa.int64()),
                "shard": pa.array(np.full(len(owner), table.column("shard")[0].as_py()), pa.int32()),
                "bin": pa.array(np.concatenate([bins, first + np.arange(len(whole))]), pa.int64()),
                "bin_offset": pa.array(np.concatenate([offsets, np.zeros(len(whole), np.int64)]), pa.int64()),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread.withColumn("place", F.xxhash64("n", "doc_id", "salt", F.lit(8))).groupBy("shard").applyInArrow(run, f"doc_id {kind}, {PLACES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
