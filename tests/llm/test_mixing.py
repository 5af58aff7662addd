import duckdb
import numpy as np
import pandas as pd

from pointloom.llm.mixing import KEEP, MARGINS, SQL, mix, rake, sampled, topic

from .helpers import ODD, clashing, corpus, frame, untouched


def cells(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 1000))) for i in range(4) for j in range(3) for k in range(2)]
    return pd.DataFrame(rows, columns=[*MARGINS, "total"])


def test_margins_are_met():
    c = cells()
    targets = {"source": {f"s{i}": i + 1 for i in range(4)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": 1.0}
    out = rake(c, targets, rounds=200)
    w = (out.weight * out.total).groupby(out.source).sum() / (out.weight * out.total).sum()
    assert np.allclose(w.to_numpy(), [0.1, 0.2, 0.3, 0.4])
    w = (out.weight * out.total).groupby(out.lang).sum()
    assert np.allclose((w / w.sum()).to_numpy(), [0.5, 0.3, 0.2])


def test_rate_gives_the_expected_tokens():
    for keep in (0.1, 0.5, 0.8, 1.0):
        out = rake(cells(1), keep=keep)
        assert np.isclose((out.p * out.total).sum(), keep * out.total.sum())
        assert (out.p <= 1).all()


def test_zero_targets_and_no_tokens():
    c = cells(2)
    c.loc[0, "total"] = 0
    out = rake(c, {"source": {"s1": 1.0}, "lang": 1.0, "topic": 1.0})
    assert (out.p[out.source != "s1"] == 0).all() and (out.p[out.source == "s1"] > 0).any()
    assert (rake(c.assign(total=0.0)).p == 0).all()


def test_like_sql(spark):
    rows = corpus(5, 200)
    rows = [(i, t + (" | cell" if i % 6 == 0 else " Licensed under" if i % 10 == 1 else ""), lang, s) for i, t, lang, s in rows]
    docs = frame(spark, rows)
    cols = ["doc_id", "topic", "tokens", "weight", "p", "is_kept"]
    got = sampled(docs).select(cols).toPandas().round(6).sort_values("doc_id", ignore_index=True)
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(SQL).df()[cols].sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert set(got.topic) == {"prose", "tabular", "legal"}


def test_sample_follows_p(spark):
    docs = frame(spark, [(i, "word " * 20, "en" if i % 4 else "de", f"s{i % 3}") for i in range(4000)])
    out = sampled(docs).toPandas()
    assert abs(out.is_kept.mean() - KEEP) < 0.03
    by = out.groupby("lang").agg(p=("p", "mean"), k=("is_kept", "mean"))
    assert (abs(by.p - by.k) < 0.04).all()


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    out = sampled(docs)
    assert out.count() == len(ODD)
    assert mix(docs).columns == docs.columns
    untouched(clashing(docs), mix(clashing(docs)), mix(docs).count())
    assert mix(docs.limit(0)).count() == 0
    twins = [r.is_kept for r in out.where("doc_id = 6").collect()]
    assert twins[0] == twins[1]
    assert docs.select(topic().alias("t")).where("t is null").count() == 0
