import numpy as np
import pyarrow as pa

from pointloom.llm.common import Words, arrow_text
from pointloom.llm.near_dedup import cardinality, exact_jaccard, flag_near, joint_jaccard, merge, near_dedup, shingle_hashes, sketch

from .helpers import ODD, clashing, corpus, frame, untouched


def shingles(text, k=3):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, threshold=0.5):
    """Group of each row: smallest id over connected pairs."""
    sets = [shingles(t or "") for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_groups_like_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 80)
        got = {r.doc_id: r.group_id for r in flag_near(frame(spark, rows)).collect()}
        assert got == brute(rows)


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for j in (0.2, 0.5, 0.9):
        n = int(2000 * 2 * j / (1 + j))
        a, b = base[:2000], np.concatenate([base[:n], base[2000 : 4000 - n]])
        x, y = (sketch(s, np.array([0, len(s)]), 2048) for s in (a, b))
        assert abs(joint_jaccard(x, y)[0] - j) < 0.05
        assert abs(cardinality(x)[0] / 2000 - 1) < 0.1
        both = np.concatenate([a, b])
        assert (merge(x, y) == sketch(both, np.array([0, len(both)]), 2048)).all()


def test_shingles_do_not_cross_documents():
    data, off = arrow_text(pa.array(["a b c d", "a b", None, "", "b c d a b"]))
    h, at = shingle_hashes(Words().split(data, off))
    assert np.diff(at).tolist() == [2, 1, 0, 0, 3]
    assert h[1] == h[3]


def test_exact_jaccard(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d f"), ("a", "a"), ("a b", "b a")], "a string, b string")
    got = [r[0] for r in df.select(exact_jaccard("a", "b")).collect()]
    assert got == [0.5, 1.0, 0.0]


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    rows = flag_near(docs).collect()
    assert len(rows) == len(ODD)
    same = [r for r in rows if r.text and r.text.startswith("same")]
    assert {r.group_id for r in same} == {5} and [r.doc_id for r in same if r.is_kept] == [5]
    assert all(r.is_kept for r in rows if not r.text or not r.text.startswith("same"))
    untouched(clashing(docs), near_dedup(clashing(docs)), len(ODD) - 3)
    assert near_dedup(docs).columns == docs.columns
    assert near_dedup(docs.limit(0)).count() == 0


def test_large_group_has_one_keeper(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(i, base + f" tail{i}") for i in range(300)]
    assert [r.doc_id for r in near_dedup(frame(spark, rows)).collect()] == [0]
