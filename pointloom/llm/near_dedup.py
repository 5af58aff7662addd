"""Near-duplicate documents with SetSketch registers (operator 6).

A document is the set of its runs of SHINGLE words. Register i keeps the
truncated minimum of an exponential variate over the set on an exponential
scale, K_i = max(0, min(TOP, floor(1 - log_b min h_i))): sketches of parts merge
by the elementwise maximum, and equal registers are likelier the more similar
the sets are. BANDS bands of ROWS registers give candidates; their similarity
is estimated from the joint likelihood of the registers (the counts of larger,
smaller and equal ones), and pairs that may reach the threshold are verified by
the exact Jaccard similarity of their shingle sets. Groups are the connected
components of verified pairs.

Candidates of a band bucket: every member is paired with one random member
first, its hub. After grouping, all pairs of one bucket's other members that are
still in different groups are paired too, so every pair of a bucket is either in
one group or has been judged: no cap is needed. A bucket of two has no other
pair, so chance collisions, whose number grows faster than the corpus, cost one
estimate each and no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cluster import components
from .common import Words, arrow_text, buckets, column, content_key, fresh, mix, pieces, stored

SHINGLE, THRESHOLD = 3, 0.5
BANDS, ROWS = 32, 3
BASE, RATE, TOP = 1.02, 20.0, 4094
#: A candidate goes to verification if its estimate is at least THRESHOLD less
#: this, two standard deviations of the estimate.
MARGIN = 0.1


def _salts(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(6).integers(0, 1 << 32, (2, m), dtype=np.uint64).astype(np.uint32)
    return r[0], r[1] | np.uint32(1)


def shingle_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a piece in document order, and their offsets. A
    document of fewer than SHINGLE words is one shingle of all its words."""
    h, at = w.windows(SHINGLE)
    count = np.diff(w.at)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            more = k < count[short]
            extra[more] = mix(extra[more] * np.uint64(31) + w.hash[w.at[short[more]] + k])
        place = np.searchsorted(at, w.at[short])
        h, at = np.insert(h, place, extra), np.insert(at, place, w.at[short])
    return h, np.searchsorted(at, w.at)


def registers(lowest: np.ndarray) -> np.ndarray:
    """Registers from the smallest 32-bit hash of each (document, register)."""
    u = (lowest.astype(np.float64) + 0.5) / 2.0**32
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sketch(h: np.ndarray, at: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Registers (documents x m) of shingle sets that are not empty."""
    xor, mul = _salts(m)
    x = (h >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(at) - 1, m), np.uint32)
    part = np.empty_like(x)
    for i in range(m):
        np.bitwise_xor(x, xor[i], out=part)
        np.multiply(part, mul[i], out=part)
        part ^= part >> np.uint32(15)
        low[:, i] = np.minimum.reduceat(part, at[:-1])
    return registers(low)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def cardinality(k: np.ndarray) -> np.ndarray:
    """Number of distinct shingles, estimated from registers (rows of k)."""
    m = k.shape[-1]
    return m * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.power(BASE, -k.astype(np.float64)).sum(-1))


def joint_jaccard(a: np.ndarray, b: np.ndarray, grid: int = 100) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows)."""
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - plus - minus
    na, nb = cardinality(a), cardinality(b)
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    best, where = np.full(len(a), -np.inf), np.zeros(len(a))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    for g in range(grid + 1):
        j = top * g / grid
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        score = plus * np.log(more + tiny) + minus * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, tiny))
        up = score > best
        best[up], where[up] = score[up], j[up]
    return where


def sketched(rows: DataFrame) -> DataFrame:
    """(key, sk, bands) of rows (key binary, text): the registers as bytes and
    one hash per band; rows without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            data, off = arrow_text(batch.column(1))
            for first, raw, o in pieces(data, off):
                h, at = shingle_hashes(words.split(raw, o))
                have = np.flatnonzero(np.diff(at))
                if not len(have):
                    continue
                k = sketch(h, np.append(at[have], at[-1]))
                band = np.tile(salt, (len(have), 1))
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x2545F4914F6CDD1D) + k[:, r::ROWS].astype(np.uint64))
                n = len(have)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + have)),
                        pa.array([r.tobytes() for r in k], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(band.view(np.int64).ravel())),
                    ],
                    ["key", "sk", "bands"],
                )

    return rows.mapInArrow(run, "key binary, sk binary, bands array<bigint>")


@F.arrow_udf(T.DoubleType())
def estimated(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), -1) for c in (a, b))
    return pa.array(joint_jaccard(x, y))


def _sets(column: pa.Array) -> list[np.ndarray]:
    data, off = arrow_text(column)
    words, out = Words(), []
    for _, raw, o in pieces(data, off):
        h, at = shingle_hashes(words.split(raw, o))
        out += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
    return out


@F.arrow_udf(T.DoubleType())
def exact_jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    # a hub stands in many pairs: its set is made once a batch
    a, b = a.dictionary_encode(), b.dictionary_encode()
    left, right = _sets(a.dictionary), _sets(b.dictionary)
    out = []
    for i, j in zip(a.indices.to_pylist(), b.indices.to_pylist()):
        x, y = sorted((left[i], right[j]), key=len)
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
        out.append(common / max(1, len(x) + len(y) - common))
    return pa.array(out, pa.float64())


def across(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of members (bucket, key, comp, sk) of one bucket and
    different components whose estimated similarity is at least `least`. The
    members travel once per bucket; the pairs are formed where they meet."""

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of whole buckets: a loose bound on equal registers, the larger
        part of the likelihood, then the estimate for many pairs at a time. At
        the threshold the bound is three standard deviations off: it costs one
        pair in a thousand, the estimate's margin two in a hundred."""
        keys, bucket = table.column("key").to_pylist(), np.asarray(table.column("bucket"))
        k = np.frombuffer(b"".join(table.column("sk").to_pylist()), np.uint16).reshape(len(keys), -1)
        group = np.unique(np.array([c.hex() for c in table.column("comp").to_pylist()]), return_inverse=True)[1].ravel()
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        left, right, size = [], [], 0

        def judged() -> pa.RecordBatch:
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            good = joint_jaccard(k[i], k[j]) >= least if len(i) else np.zeros(0, bool)
            pairs = {(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in zip(i[good].tolist(), j[good].tolist())}
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])

        for lo, hi in zip(cut[:-1], cut[1:]):
            for i in range(lo, hi - 1):
                j = np.flatnonzero(group[i + 1 : hi] != group[i]) + i + 1
                j = j[(k[j] == k[i]).mean(1) >= least - 0.05]
                if len(j):
                    left.append(np.full(len(j), i))
                    right.append(j)
                    size += len(j)
                if size >= 1 << 17:
                    yield judged()
                    left, right, size = [], [], 0
        yield judged()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            b = np.asarray(held.column("bucket"))
            if not len(b):
                continue
            last = int(np.flatnonzero(b != b[-1])[-1]) + 1 if (b != b[-1]).any() else 0
            if last:
                yield from emit(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from emit(held)

    # a number of its own: the rows are small, the work on them is not, so they must not be coalesced
    return members.repartition(buckets(members), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a binary, b binary")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, group, lead, size) of the contents that have a near-duplicate;
    key is the content's MD5, lead marks the content to keep."""
    text_of, id_of = column(text_col), column(id_col)
    rows = docs.where(text_of.isNotNull()).select(content_key(text_of).alias("key"), text_of.alias("text"), id_of.alias("id"))
    seen = stored(sketched(rows.select("key", "text")).groupBy("key").agg(F.first("sk").alias("sk"), F.first("bands").alias("bands")), "sketches")
    crowd = Window.partitionBy("bucket")
    # one order for all bands, so that a group mostly has one hub
    member = seen.select(F.explode("bands").alias("bucket"), "key")
    hub = member.withColumn("hub", F.min_by("key", F.xxhash64("key")).over(crowd)).withColumn("n", F.count(F.lit(1)).over(crowd))
    shared = stored(hub.where("n > 1").select("bucket", "key", "hub", "n"), "buckets")
    left, right = (seen.select(F.col("key").alias(c), F.col("sk").alias(f"sk_{c}")) for c in "ab")
    stars = shared.where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    likely = stored(stars.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(estimated("sk_a", "sk_b") >= threshold - MARGIN).select("a", "b"), "likely")
    # the hub has been judged against everyone in its bucket
    others = shared.where("n > 2 and key <> hub")
    # joins against texts are sort-merge joins at every size: what is sought grows with the corpus
    wanted = likely.select(F.explode(F.array("a", "b")).alias("key")).union(others.select("key")).distinct()
    text = stored(rows.join(wanted.hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "texts")
    x, y = (text.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def verified(likely: DataFrame) -> DataFrame:
        """Pairs (a, b) that reach the threshold."""
        return likely.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(exact_jaccard("text_a", "text_b") >= threshold).select("a", "b")

    sure = stored(verified(likely), "stars")
    label = components(sure)
    placed = others.join(label, others.key == label.node, "left").select("bucket", "key", F.coalesce("comp", "key").alias("comp"))
    mixed = placed.withColumn("lo", F.min("comp").over(crowd)).withColumn("hi", F.max("comp").over(crowd)).where("lo <> hi").select("bucket", "key", "comp")
    cross = across(mixed.join(seen.select("key", "sk"), "key").select("bucket", "key", "comp", "sk"), threshold - MARGIN).distinct()
    more = stored(verified(cross), "cross")
    if not more.isEmpty():
        label = components(sure.union(more))
    lowest = rows.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("comp")
    return (
        label.join(lowest, label.node == lowest.key)
        .withColumn("lead", F.row_number().over(whole.orderBy(F.col("id").asc_nulls_last(), "key")) == 1)
        .withColumn("group", F.min("id").over(whole))
        .withColumn("size", F.sum("n").over(whole))
        .select("key", "group", "lead", "size")
    )


def _flagged(docs: DataFrame, id_col: str, text_col: str, threshold: float, names: list[str]) -> DataFrame:
    """docs with three more columns, called as given: the group's smallest id,
    its rows, and whether the row is the one that stays."""
    group_id, size, kept = names
    own = fresh(docs, "key", "group", "lead", "size")
    key, group, lead, rows = own
    found = groups(docs, id_col, text_col, threshold).toDF(*own)
    text, ident = column(text_col), column(id_col)
    present = docs.where(text.isNotNull()).withColumn(key, content_key(text)).join(found, key, "left")
    same = Window.partitionBy(key)
    flagged = present.withColumns(
        {
            group_id: F.coalesce(F.col(group), F.min(ident).over(same)),
            size: F.coalesce(F.col(rows), F.count(F.lit(1)).over(same)),
            kept: F.coalesce(F.col(lead), F.lit(True)) & (F.row_number().over(same.orderBy(ident.asc_nulls_last())) == 1),
        }
    )
    absent = docs.where(text.isNull()).withColumns({group_id: ident, size: F.lit(1).cast("long"), kept: F.lit(True)})
    columns = [*map(column, docs.columns), *names]
    return flagged.select(*columns).unionByName(absent.select(*columns))


def flag_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `group_id` (smallest id of the group), `group_size` (rows) and
    `is_kept` (exactly one row of each group: the smallest id, null ids last).

    Equal texts are always one group. Texts that are null or have no words are
    in no group: kept, group_size 1, except that equal blank texts are copies
    of each other. Texts of any length are shingled whole. Ties are broken by
    content, of rows equal in id and text one is kept. Other columns pass
    through; columns of the three names above are replaced. An empty table
    gives an empty table.
    """
    names = ["group_id", "group_size", "is_kept"]
    return _flagged(docs.drop(*names), id_col, text_col, threshold, names)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group, all columns as given, whatever their names; which
    row, and what nulls, empty and long texts, ties and empty tables give, is
    as in flag_near."""
    names = fresh(docs, "group_id", "group_size", "is_kept")
    return _flagged(docs, id_col, text_col, threshold, names).where(F.col(names[2])).select(*map(column, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return flag_near(docs).select("doc_id", "group_id", "group_size", "is_kept")


#: Exact groups by comparing all pairs that share a shingle; the search above is
#: approximate, so on other tables a few pairs at the threshold may differ.
SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x09-\\x0d ]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node AND r.root < l.b),
groups AS (SELECT node, min(root) AS group_id FROM reach GROUP BY node)
SELECT node AS doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, node = group_id AS is_kept FROM groups
"""
