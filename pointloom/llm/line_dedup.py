"""Line dedup by a deletion-neighbourhood join (operator 10).

Lines are compared as sequences of words. Equal lines meet by two independent
hashes of 64 bits; the earliest stays. Lines of MIN_NEAR words or more also meet when one word is
replaced, inserted or missing: every line emits the hashes of itself and of all
variants with one word deleted, equal variants are joined, the pairs' edit
distance is verified, and the earliest line of a pair stays.

Two lines within one edit share their first or their second half, so lines that
share no half with another line emit no variants: nothing is lost by that.
Within a variant class no pairs are enumerated. Lines of equal length that lost
the same position are all within one edit of each other, so each is paired with
the earliest; a line that equals another's variant is paired with that class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, arrow_text, mix, pieces, stored

#: Defaults: lines of fewer words stay; lines of fewer words match exactly only.
MIN_LINE, MIN_NEAR = 4, 8


class Lines:
    """The lines of a piece: word offsets `at`, owning document, number in it."""

    def __init__(self) -> None:
        self.words = Words(second=True)

    def split(self, raw: np.ndarray, off: np.ndarray) -> "Lines":
        cut = np.union1d(np.flatnonzero(raw == 10) + 1, off)
        w = self.words.split(raw, cut)
        start = cut[:-1]
        self.doc = np.searchsorted(off, start, "right") - 1
        self.number = np.arange(len(start)) - np.searchsorted(start, off)[self.doc]
        self.at, self.n, self.w, self.cut = w.at[:-1], np.diff(w.at), w, cut
        self.up, self.down = self.words.words.get(len(w.hash) + 2)
        self.total = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * self.up[: len(w.hash)], out=self.total[1:])
        self.up2, self.down2 = self.words.words2.get(len(w.hash) + 2)
        self.total2 = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash2 * self.up2[: len(w.hash)], out=self.total2[1:])
        return self

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a..b-1, the same wherever they stand."""
        return (self.total[b] - self.total[a]) * self.down[a]

    def keys(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both line hashes, and four hashes of halves: of the line's own length
        and of one word more."""
        a, n = self.at[pick], self.n[pick]
        whole = mix(self.run(a, a + n) + n.astype(np.uint64))
        other = mix((self.total2[a + n] - self.total2[a]) * self.down2[a] + n.astype(np.uint64))
        halves = []
        for m in (n, n + 1):
            tag = m.astype(np.uint64) * np.uint64(2)
            halves.append(mix(mix(self.run(a, a + m // 2)) + tag))
            halves.append(mix(mix(self.run(a + n - (m + 1) // 2, a + n)) + tag + np.uint64(1)))
        return whole, other, np.stack(halves, 1)

    def variants(self, i: int) -> np.ndarray:
        """Hashes of line i without each of its words in turn."""
        a, b = int(self.at[i]), int(self.at[i] + self.n[i])
        k = np.arange(a, b)
        head = (self.total[k] - self.total[a]) * self.down[a]
        tail = (self.total[b] - self.total[k + 1]) * self.down[a + 1]
        return mix(head + tail)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def line_keys(docs: DataFrame, min_line: int, min_near: int) -> DataFrame:
    """(doc_id, line_no, lh, li, halves) of lines of min_line words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines()
        for batch in batches:
            data, off = arrow_text(batch.column(1))
            for first, raw, o in pieces(data, off):
                x = lines.split(raw, o)
                pick = np.flatnonzero(x.n >= max(min_line, 1))
                whole, other, halves = x.keys(pick)
                near = x.n[pick] >= min_near
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + x.doc[pick])), pa.array(x.number[pick], pa.int32()), pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), _lists(halves[near].ravel().view(np.int64), near * 4)],
                    ["doc_id", "line_no", "lh", "li", "halves"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line_no int, lh bigint, li bigint, halves array<bigint>")


def candidate_lines(docs: DataFrame, wanted: DataFrame, min_near: int) -> DataFrame:
    """(lh, li, n, line, whole, variants) of the lines `wanted` (doc_id, lh)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines()
        for batch in batches:
            asked = batch.column(1)
            flat, bounds = np.asarray(asked.flatten()), np.concatenate([[0], np.cumsum(np.asarray(asked.value_lengths()))])
            data, off = arrow_text(batch.column(0))
            for first, raw, o in pieces(data, off):
                x = lines.split(raw, o)
                docs_in = len(o) - 1
                pick = np.flatnonzero(x.n >= min_near)
                whole, other, _ = x.keys(pick)
                h, second = whole.view(np.int64), other.view(np.int64)
                ask = flat[bounds[first] : bounds[first + docs_in]]
                who = np.repeat(np.arange(docs_in), np.diff(bounds[first : first + docs_in + 1]))
                # (document, hash) pairs that were asked for
                hit = np.isin(h, ask)
                pairs = set(zip(who.tolist(), ask.tolist()))
                chosen = [(i, int(k), int(m)) for i, k, m, y in zip(pick, h, second, hit) if y and (int(x.doc[i]), int(k)) in pairs]
                if not chosen:
                    continue
                rows = np.array([i for i, *_ in chosen])
                made = [x.variants(i) for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for _, k, _ in chosen], pa.int64()),
                        pa.array([m for *_, m in chosen], pa.int64()),
                        pa.array(x.n[rows], pa.int32()),
                        pa.array([raw[x.cut[i] : x.cut[i + 1]].tobytes().decode("utf-8", "replace") for i in rows], pa.string()),
                        pa.array(mix(x.run(x.at[rows], x.at[rows] + x.n[rows])).view(np.int64)),
                        _lists(np.concatenate(made).view(np.int64), np.array([len(m) for m in made])),
                    ],
                    ["lh", "li", "n", "line", "whole", "variants"],
                )

    asked = wanted.groupBy("doc_id").agg(F.collect_set("lh").alias("asked"))
    # a sort-merge join at every size: the lines sought grow with the corpus
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id"))).select("text", "asked")
    return rows.mapInArrow(run, "lh bigint, li bigint, n int, line string, whole bigint, variants array<bigint>").groupBy("lh", "li").agg(*[F.first(c).alias(c) for c in ("n", "line", "whole", "variants")])


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one word replaced, inserted or deleted turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, short = 0, min(len(a), len(b))
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


@F.arrow_udf(T.BooleanType())
def _verified(a: pa.Array, b: pa.Array) -> pa.Array:
    split = lambda s: s.encode().split()
    return pa.array([within_one_edit(split(x), split(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def duplicate_lines(docs: DataFrame, min_line: int = MIN_LINE, min_near: int = MIN_NEAR) -> DataFrame:
    """The lines to remove: (doc_id, line_no, keep_doc_id, keep_line_no, kind),
    ids as given.

    Lines end at line feeds and are numbered from 0; words are separated by
    ASCII whitespace and compared byte by byte. Order is by doc_id (null last)
    and line number. kind is "near" if an earlier line of the corpus is within
    one word edit (then the earliest of these is named), else "exact" if an
    equal line comes earlier. Lines of fewer than min_line words, and blank
    ones, are never removed, lines of fewer than min_near words only as exact
    copies. Null and empty texts have no lines to remove; very long texts and
    lines are taken whole. Ties: rows with equal id and text are one document,
    they get the same lines, each row its own. Extra columns are ignored,
    whatever their names; an empty table gives an empty table.
    """
    key = ["lh", "li"]
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "line_no")
    lines = stored(line_keys(docs, min_line, min_near), "lines")
    first = stored(lines.groupBy(*key).agg(F.min(place).alias("at"), F.first("halves").alias("halves")), "distinct")
    shared = first.select(*key, F.explode("halves").alias("half")).withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("half"))).where("many > 1").select(*key).distinct()
    wanted = stored(first.join(shared, key, "left_semi").select(*key, "at", "at.doc_id"), "wanted")
    text = stored(candidate_lines(docs, wanted, min_near), "candidates").join(wanted.select(*key, "at"), key)
    made = text.select(F.posexplode("variants").alias("i", "v"), "n", *key, "at")
    made = made.unionByName(text.select(F.lit(-1).alias("i"), F.col("whole").alias("v"), (F.col("n") + 1).alias("n"), *key, "at"))
    member = F.struct("at", *key)
    crowd, slot = Window.partitionBy("v", "n"), Window.partitionBy("v", "n", "i")
    whole = F.col("i") == -1
    made = (
        made.withColumn("many", F.count(F.lit(1)).over(crowd))
        .where("many > 1")
        .withColumn("same", F.min(member).over(slot))
        .withColumn("short", F.min(F.when(whole, member)).over(crowd))
        .withColumn("long", F.min(F.when(~whole, member)).over(crowd))
    )
    pairs = made.select(member.alias("x"), F.explode(F.array("same", F.when(whole, F.col("long")).otherwise(F.col("short")))).alias("y")).where("y is not null and y.at < x.at").select("x.lh", "x.li", F.col("y.lh").alias("lh2"), F.col("y.li").alias("li2"), F.col("y.at").alias("at2")).distinct()
    a, b = text.select(*key, "line"), text.select(F.col("lh").alias("lh2"), F.col("li").alias("li2"), F.col("line").alias("line2"))
    near = pairs.join(a, key).join(b, ["lh2", "li2"]).where(_verified("line", "line2")).groupBy(*key).agg(F.min("at2").alias("near"))
    decided = stored(first.select(*key, "at").join(near, key, "left"), "decided")
    keep = F.coalesce("near", "at")
    return (
        lines.drop("halves")
        .join(decided, key)
        .where(F.col("near").isNotNull() | (place != F.col("at")))
        .select("doc_id", "line_no", keep.doc_id.alias("keep_doc_id"), keep.line_no.alias("keep_line_no"), F.when(F.col("near").isNotNull(), "near").otherwise("exact").alias("kind"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(l, '[\\x09-\\x0d ]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(a) AS l, unnest(range(len(a)))::INTEGER AS line_no FROM split)),
long AS (SELECT doc_id, line_no, w, len(w) AS n, array_to_string(w, ' ') AS line FROM lines WHERE len(w) >= {MIN_LINE}),
firsts AS (SELECT line, any_value(w) AS w, any_value(n) AS n, min(struct_pack(d := doc_id, l := line_no)) AS spot FROM long GROUP BY line),
made AS (SELECT line, n, spot, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 : n]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= {MIN_NEAR})),
met AS (SELECT line, spot, min(spot) OVER (PARTITION BY v, n, i) AS other FROM made
        UNION ALL SELECT m.line, m.spot, f.spot FROM made m JOIN firsts f ON f.line = m.v AND f.n >= {MIN_NEAR}
        UNION ALL SELECT f.line, f.spot, m.spot FROM made m JOIN firsts f ON f.line = m.v AND f.n >= {MIN_NEAR}),
near AS (SELECT line, min(other) AS near FROM met WHERE other < spot GROUP BY line)
SELECT doc_id, line_no, coalesce(near, spot).d AS keep_doc_id, coalesce(near, spot).l AS keep_line_no, CASE WHEN near IS NULL THEN 'exact' ELSE 'near' END AS kind
FROM long JOIN firsts USING (line) LEFT JOIN near USING (line) WHERE near IS NOT NULL OR spot <> struct_pack(d := doc_id, l := line_no)
"""
