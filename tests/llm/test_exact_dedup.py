import struct

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm.exact_dedup import SQL, QuotientFilter, exact_dedup, flag_exact, repeated_fingerprints

from .helpers import ODD, clashing, corpus, frame, untouched


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 40)), max_size=200))
def test_filter_round_trip(values):
    fp = np.array(values, np.uint64)
    got, count = QuotientFilter.read(QuotientFilter.build(fp))
    want, n = np.unique(fp, return_counts=True)
    assert got.tolist() == want.tolist() and count.tolist() == n.tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=50), max_size=5))
def test_merge_is_lossless(parts):
    merged = QuotientFilter.merge([QuotientFilter.build(np.array(p, np.uint64)) for p in parts])
    whole = QuotientFilter.build(np.array([x for p in parts for x in p], np.uint64))
    assert merged == whole


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**50), max_size=50), max_size=5), st.integers(0, 14))
def test_merge_in_a_range(parts, lead):
    """Filters of one range of the hash space: the leading bits are shared."""
    top = 2**63 + 2**62 + 2**55
    arrays = [np.array([top + x for x in p], np.uint64) for p in parts if p]
    blobs = [QuotientFilter.build(a, lead=min(lead, 9)) for a in arrays]
    got, count = QuotientFilter.merged(blobs)
    want, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *arrays]), return_counts=True)
    assert got.tolist() == want.tolist() and count.tolist() == n.tolist()
    assert QuotientFilter.read(QuotientFilter.merge(blobs, min(lead, 9)))[0].tolist() == want.tolist()


def test_quotients_spread_inside_a_range():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**54, 3000, dtype=np.uint64) | np.uint64(0b1011001101 << 54)
    blob = QuotientFilter.build(fp, lead=10)
    _, q, *_ = struct.unpack_from(QuotientFilter.head, blob)
    occupied = np.unpackbits(np.frombuffer(blob, np.uint8, (1 << q) // 8, struct.calcsize(QuotientFilter.head)))
    assert q == 12 and occupied.sum() > 0.45 * (1 << q)


def test_repeated_fingerprints(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, -5, 7, -5, -5, 9]], "x bigint").repartition(3)
    assert sorted(r.fp for r in repeated_fingerprints(df).collect()) == [-5, 1]
    many = spark.range(50_000).selectExpr("xxhash64(id % 40000) as x").repartition(5)
    got = {r.fp for r in repeated_fingerprints(many).collect()}
    assert got == {r.x for r in spark.range(10_000).selectExpr("xxhash64(id) as x").collect()}


def test_like_sql(spark, tmp_path):
    docs = frame(spark, corpus())
    got = sorted(tuple(r) for r in flag_exact(docs).select("doc_id", "keep_id", "copies", "is_kept").collect())
    documents = docs.toPandas()  # noqa: F841  read by the SQL below
    assert got == sorted(duckdb.sql(SQL).fetchall())


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    rows = flag_exact(docs).collect()
    assert len(rows) == len(ODD)
    same = [r for r in rows if r.text and r.text.startswith("same")]
    assert {r.keep_id for r in same} == {5} and {r.copies for r in same} == {4}
    assert [r.doc_id for r in same if r.is_kept] == [5]
    assert all(r.is_kept and r.copies == 1 for r in rows if r.text is None)
    assert exact_dedup(docs).columns == docs.columns
    untouched(clashing(docs), exact_dedup(clashing(docs)), len(ODD) - 3)
    assert exact_dedup(docs.limit(0)).count() == 0
