"""Substring dedup with fixed-block anchors (operator 1).

Texts are sequences of whitespace-separated words. Non-overlapping blocks of
BLOCK words are indexed as references, and every rolling window of BLOCK words
of every document probes the index: a block hit by a window other than itself
is an anchor. Any repeat of 2 * BLOCK - 1 words or more contains a whole block
of each document it occurs in, so every document with such a repeat has anchors
of its own and no pairs of documents need to be formed. Around anchors, windows
of MIN_WORDS words are extended one word at a time as long as they occur
elsewhere, which gives the maximal exact repeats.

Windows travel as sorted, delta-coded 48-bit fingerprints (about 4 bytes each)
in one binary value per task and hash range. A false hit costs a little work,
as the extension compares 96 bits of two independent hashes. Contents are known
by 128-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, Words, arrow_keys, arrow_text, buckets, content_key, keys_of, pieces
from .exact_dedup import hash_range

BLOCK, MIN_WORDS = 20, 40
#: Windows held by a task before it emits a run.
RUN = 1 << 22


def encode(sorted_fp: np.ndarray) -> bytes:
    """Sorted uint64 values below 2^48 as deltas of 4 bytes (8 where they don't fit)."""
    if not len(sorted_fp):
        return b""
    step = np.diff(sorted_fp)
    wide = bool(len(step)) and int(step.max()) >= 1 << 32
    return bytes([wide]) + sorted_fp[:1].astype("<u8").tobytes() + step.astype("<u8" if wide else "<u4").tobytes()


def decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    step = np.frombuffer(blob, "<u8" if blob[0] else "<u4", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1, 1), step]), dtype=np.uint64)


def _cuts(h: np.ndarray, n: int) -> np.ndarray:
    """Where each of n hash ranges begins in sorted hashes, and their end."""
    return np.searchsorted(hash_range(h, n), np.arange(n + 1))


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def anchors(contents: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rk, pos) of the blocks that some other window repeats; contents (rk, text)."""
    n = buckets(contents)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, blocks, size = Words(), [], [], 0

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            bh, rk, pos = (np.concatenate(x) for x in zip(*blocks))
            order = np.argsort(bh)
            bh, rk, pos = bh[order], rk[order], pos[order]
            a, b = _cuts(h, n), _cuts(bh, n)
            some = np.flatnonzero(np.diff(a))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    _binary([encode(h[a[k] : a[k + 1]] >> np.uint64(16)) for k in some]),
                    _binary([(bh[b[k] : b[k + 1]] >> np.uint64(16)).tobytes() + rk[b[k] : b[k + 1]].tobytes() + pos[b[k] : b[k + 1]].tobytes() for k in some]),
                ],
                ["bucket", "windows", "blocks"],
            )

        for batch in batches:
            keys = keys_of(batch.column(0))
            data, off = arrow_text(batch.column(1))
            for first, raw, o in pieces(data, off):
                w = words.split(raw, o)
                h, at = w.windows(block)
                owner = np.searchsorted(w.at, at, "right") - 1
                place = at - w.at[owner]
                own = place % block == 0
                held.append(h)
                blocks.append((h[own], keys[first + owner[own]], place[own].astype(np.int32)))
                size += len(h)
                if size >= RUN:
                    yield flush()
                    held, blocks, size = [], [], 0
        if size:
            yield flush()

    def probe(table: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([decode(x) for x in table.column("windows").to_pylist()]))
        bh, rk, pos = [], [], []
        for x in table.column("blocks").to_pylist():
            m = len(x) // 28
            bh.append(np.frombuffer(x, np.uint64, m))
            rk.append(np.frombuffer(x, KEY, m, 8 * m))
            pos.append(np.frombuffer(x, np.int32, m, 24 * m))
        bh, rk, pos = (np.concatenate(x) for x in (bh, rk, pos))
        # a block is a window itself, so one occurrence is its own
        i = np.searchsorted(h, bh)
        hit = (i + 1 < len(h)) & (h[np.minimum(i + 1, len(h) - 1)] == bh)
        return pa.table({"rk": arrow_keys(rk[hit]), "pos": pos[hit]})

    runs = contents.mapInArrow(emit, "bucket int, windows binary, blocks binary")
    return runs.groupBy("bucket").applyInArrow(probe, "rk binary, pos int")


def repeats(contents: DataFrame, block: int = BLOCK, width: int = MIN_WORDS) -> DataFrame:
    """(rk, start_word, n_words): the maximal repeats of each content."""
    if width < 2 * block - 1:
        raise ValueError("a repeat of min_words must contain a whole block: min_words >= 2 * block - 1")
    n = buckets(contents)
    found = anchors(contents, block).groupBy("rk").agg(F.collect_list("pos").alias("pos"))
    near = contents.join(found, "rk").groupBy("rk").agg(F.first("text").alias("text"), F.first("pos").alias("pos"), F.count(F.lit(1)).alias("n"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of `width` words around anchors, by hash range; contents
        that occur more than once are repeats as a whole."""
        words, held, whole, size = Words(second=True), [], [], 0

        def flush() -> pa.RecordBatch:
            h1, h2, rk, pos, single = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h1)
            h1, h2, rk, pos, single = h1[order], h2[order], rk[order], pos[order], single[order]
            a = _cuts(h1, n)
            some = np.flatnonzero(np.diff(a))
            blobs = []
            for k in some:
                s = slice(a[k], a[k + 1])
                one = np.argsort(~single[s], kind="stable")  # those that want an answer come first
                m = int(single[s].sum())
                blobs.append(np.array([m, len(one)], np.int64).tobytes() + h1[s][one].tobytes() + h2[s][one].tobytes() + rk[s][one][:m].tobytes() + pos[s][one][:m].tobytes())
            k, c = np.concatenate([np.zeros(0, KEY)] + [x for x, _ in whole]), np.concatenate([np.zeros(0, np.int64)] + [x for _, x in whole])
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(some, pa.int32()), pa.array((k["a"] % np.uint64(n)).astype(np.int32))]),
                    pa.concat_arrays([_binary(blobs), pa.nulls(len(k), pa.binary())]),
                    pa.concat_arrays([pa.nulls(len(some), pa.binary()), arrow_keys(k)]),
                    pa.concat_arrays([pa.nulls(len(some), pa.int32()), pa.array(c.astype(np.int32))]),
                ],
                ["bucket", "windows", "rk", "words"],
            )

        for batch in batches:
            keys, times = keys_of(batch.column(0)), np.asarray(batch.column(3))
            lists = batch.column(2)
            place, bounds = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            data, off = arrow_text(batch.column(1))
            for first, raw, o in pieces(data, off):
                w = words.split(raw, o)
                h1, at = w.windows(width)
                h2, _ = w.windows(width, second=True)
                docs = len(o) - 1
                # +1 / -1 marks of the windows that hold an anchored block
                mark = np.zeros(len(w.hash) + 1, np.int64)
                p = place[bounds[first] : bounds[first + docs]]
                d = np.repeat(np.arange(docs), np.diff(bounds[first : first + docs + 1]))
                size_of = np.diff(w.at)[d]
                inside = p + block <= size_of
                p, base = p[inside], w.at[:-1][d[inside]]
                np.add.at(mark, base + np.maximum(p + block - width, 0), 1)
                np.add.at(mark, base + p + 1, -1)
                take = np.cumsum(mark)[at] > 0
                h1, h2, at = h1[take], h2[take], at[take]
                owner = np.searchsorted(w.at, at, "right") - 1
                single = times[first + owner] == 1
                held.append((h1, (h2 >> np.uint64(32)).astype(np.uint32), keys[first + owner], (at - w.at[owner]).astype(np.int32), single))
                twice = np.flatnonzero((times[first : first + docs] > 1) & (np.diff(w.at) >= width))
                whole.append((keys[first + twice], np.diff(w.at)[twice]))
                size += len(h1)
                if size >= RUN // 4:
                    yield flush()
                    held, whole, size = [], [], 0
        if held:
            yield flush()

    def confirm(table: pa.Table) -> pa.Table:
        """Windows with an equal among all others, as positions by content."""
        h1, h2, rk, pos = [], [], [], []
        for x in table.column("windows").drop_null().to_pylist():
            m, size = np.frombuffer(x, np.int64, 2)
            h1.append(np.frombuffer(x, np.uint64, size, 16))
            h2.append(np.frombuffer(x, np.uint32, size, 16 + 8 * size))
            key, where = np.zeros(size, KEY), np.full(size, -1, np.int32)
            key[:m] = np.frombuffer(x, KEY, m, 16 + 12 * size)
            where[:m] = np.frombuffer(x, np.int32, m, 16 + 12 * size + 16 * m)
            rk.append(key)
            pos.append(where)
        whole = table.filter(pa.compute.is_valid(table.column("rk"))).select(["rk", "words"])
        h1, h2, rk, pos = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h1, np.uint64), (h2, np.uint32), (rk, KEY), (pos, np.int32)))
        order = np.lexsort([h2, h1])
        h1, h2, rk, pos = h1[order], h2[order], rk[order], pos[order]
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        again = np.zeros(len(h1), bool)
        again[1:] |= same
        again[:-1] |= same
        again &= pos >= 0
        rk, pos = rk[again], pos[again]
        order = np.lexsort([rk["b"], rk["a"]])
        rk, pos = rk[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], rk[1:] != rk[:-1]])) if len(rk) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rk)), pa.int32()), pa.array(pos))
        n_whole = whole.num_rows
        return pa.table(
            {
                "rk": pa.concat_arrays([arrow_keys(rk[first]), arrow_keys(keys_of(whole.column("rk")))]),
                "at": pa.concat_arrays([lists, pa.array([[]] * n_whole, pa.list_(pa.int32()))]),
                "words": pa.concat_arrays([pa.array(np.zeros(len(first), np.int32)), pa.array(np.asarray(whole.column("words")), pa.int32())]),
            }
        )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk, words = keys_of(batch.column(0)), np.asarray(batch.column(2))
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(rk)), np.asarray(lists.value_lengths()))
            p = np.asarray(lists.flatten()).astype(np.int64)
            order = np.lexsort([p, owner])
            owner, p = owner[order], p[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (p[1:] > p[:-1] + 1)])) if len(p) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(p)) - 1 if len(p) else new
            whole = np.flatnonzero(words > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    arrow_keys(np.concatenate([rk[owner[new]], rk[whole]])),
                    pa.array(np.concatenate([p[new], np.zeros(len(whole), np.int64)]), pa.int32()),
                    pa.array(np.concatenate([p[last] - p[new] + width, words[whole]]), pa.int32()),
                ],
                ["rk", "start_word", "n_words"],
            )

    windows = near.mapInArrow(extend, "bucket int, windows binary, rk binary, words int")
    hits = windows.groupBy("bucket").applyInArrow(confirm, "rk binary, at array<int>, words int")
    return hits.groupBy("rk").agg(F.flatten(F.collect_list("at")).alias("at"), F.max("words").alias("words")).mapInArrow(spans, "rk binary, start_word int, n_words int")


def repeated_spans(docs: DataFrame, block: int = BLOCK, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words): every maximal run of words whose windows
    of min_words words each occur more than once in the corpus, in another
    document, in another row or elsewhere in the same one.

    Words are counted from 0 and compared byte by byte; the whitespace between
    them is not. Spans of one document may overlap by less than min_words.
    Texts that are null, empty or shorter than min_words give no span. Rows are
    compared as rows: a repeated row is a repeat of its twin, and each gives
    its spans. Very long texts are searched whole. A null id is carried along;
    ties don't arise. Extra columns are ignored, whatever their names; an empty
    table gives an empty table.
    """
    rows = docs.where(F.col("text").isNotNull()).select(content_key("text").alias("rk"), "doc_id", "text")
    found = repeats(rows.select("rk", "text"), block, min_words)
    return rows.select("rk", "doc_id").join(found, "rk").select("doc_id", "start_word", "n_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(text, '[\\x09-\\x0d ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT r, doc_id, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS i, w FROM docs WHERE len(w) >= {MIN_WORDS}),
hashed AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1 : i + {MIN_WORDS}], ' ')) AS h FROM win),
again AS (SELECT r, doc_id, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS island FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM hashed) WHERE n > 1)
SELECT doc_id, min(i)::INTEGER AS start_word, (max(i) - min(i) + {MIN_WORDS})::INTEGER AS n_words FROM again GROUP BY r, doc_id, island
"""
