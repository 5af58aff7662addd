import random
from collections import Counter

import numpy as np

from pointloom.llm.packing import pack, sum_of_squares

from .helpers import ODD, clashing, corpus, frame


def brute(sizes, capacity):
    """The rule, bin by bin: try every open bin and a new one, count the
    squares, take the smallest, then the smallest gap left."""
    gaps, out = [], []
    for s in sizes:
        best = None
        for b in [*range(len(gaps)), None]:
            gap = capacity if b is None else gaps[b]
            if gap < s:
                continue
            left = list(gaps) + ([capacity] if b is None else [])
            left[len(gaps) if b is None else b] = gap - s
            squares = sum(n * n for g, n in Counter(left).items() if g)
            key = (squares, gap - s)
            if best is None or key < best[0]:
                best = (key, b, gap)
        _, b, gap = best
        if b is None:
            gaps.append(capacity)
            b = len(gaps) - 1
        out.append((capacity - gap, gap - s))
        gaps[b] -= s
    return out, sorted(gaps)


def test_like_brute_force():
    rng = random.Random(1)
    for capacity in (7, 20, 64):
        for _ in range(15):
            sizes = [rng.randrange(1, capacity + 1) for _ in range(60)]
            bins, offsets = sum_of_squares(np.array(sizes), capacity)
            want, gaps = brute(sizes, capacity)
            assert [(o, capacity - o - s) for o, s in zip(offsets.tolist(), sizes)] == want
            used = np.bincount(bins, sizes)
            assert sorted((capacity - used).tolist()) == gaps


def test_bins_hold_and_pieces_add_up(spark):
    docs = frame(spark, corpus(3, 300))
    out = pack(docs, 256, 100).toPandas()
    assert out.groupby(["shard", "bin"]).tokens.sum().max() <= 256
    assert out.shard.nunique() == 3
    n = {r.doc_id: -(-len(r.text.encode()) // 4) for r in docs.collect()}
    assert out.groupby("doc_id").tokens.sum().to_dict() == n
    for _, b in out.sort_values("bin_offset").groupby(["shard", "bin"]):
        assert (b.bin_offset.to_numpy() == np.concatenate([[0], b.tokens.cumsum()[:-1]])).all()
    again = pack(docs.repartition(7), 256, 100).toPandas()
    key = ["doc_id", "piece"]
    assert out.sort_values(key, ignore_index=True).equals(again.sort_values(key, ignore_index=True))


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    out = pack(docs).toPandas()
    assert set(out.doc_id.dropna()) == {3, 4, 5, 6, 7, 8}
    assert (out.doc_id == 6).sum() == 2 and out.doc_id.isna().sum() == 1
    assert out.groupby(["shard", "bin"]).tokens.sum().max() <= 2048
    assert pack(clashing(docs)).count() == len(out)
    named = pack(docs.selectExpr("concat('d', doc_id) as doc_id", "text")).toPandas()
    assert set(named.doc_id.dropna()) == {f"d{i}" for i in (3, 4, 5, 6, 7, 8)} and len(named) == len(out)
    unnamed = pack(docs.sparkSession.range(600).selectExpr("cast(null as bigint) as doc_id", "concat('same length ', id + 100000) as text"), shard_docs=100).toPandas()
    assert len(unnamed) == 600 and unnamed.shard.nunique() == 6
    assert pack(docs.limit(0)).count() == 0
