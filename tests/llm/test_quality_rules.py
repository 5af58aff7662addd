import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pointloom.llm.features import NAMES, compute
from pointloom.llm.quality_rules import calibrate, certified, fit, quality_filter, quality_verdicts, sequence, upper_bound, within_risk

from .helpers import ODD, clashing, frame, untouched, words


def test_exact_bound():
    # zero failures: (1 - p)^n = error
    assert math.isclose(upper_bound(0, 100, 0.05), 1 - 0.05 ** (1 / 100), rel_tol=1e-9)
    assert upper_bound(5, 5, 0.05) == 1.0 and upper_bound(0, 0, 0.05) == 1.0
    # coverage: Binomial(n, bound) <= k has probability error
    n, k, e = 40, 3, 0.02
    p = upper_bound(k, n, e)
    assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), e, rel_tol=1e-6)


def test_one_tail_instead_of_the_bound():
    for n in (0, 1, 50, 217, 1000):
        for k in range(0, min(n, 40) + 1):
            for risk, error in ((0.02, 0.0125), (0.1, 0.05)):
                assert within_risk(k, n, risk, error) == (n > 0 and upper_bound(k, n, error) <= risk), (k, n)
    assert within_risk(190_000, 10_000_000, 0.02, 0.01) and not within_risk(10_000_000, 10_000_000, 0.02, 0.01)


def slow_features(text):
    """Word by word and sign by sign."""
    t = text or ""
    w = [x for x in t.encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") for x in x.split()]
    if not w:
        return [0.0] * len(NAMES)
    black = b"".join(w)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    return [
        sum(c in b"#$%&*+<=>@[\\]^_`{|}~!" for c in black) / len(black),
        sum(65 <= c <= 90 for c in black) / len(black),
        max(sum(a == b for a, b in zip(w[lag:], w)) for lag in range(1, 9)) / len(w),
        (len(runs) - len(set(runs))) / max(len(runs), 1),
        sum(48 <= c <= 57 for c in black) / len(black),
        sum(len(x) > 40 for x in w) / len(w),
        math.log1p(len(w)),
    ]


def test_features_like_brute_force():
    rng = random.Random(8)
    texts = [t for _, t, *_ in ODD]
    for _ in range(60):
        pool = [rng.choice(["a", "Ab", "É!", "#x#", "1,2", "漢字", "y" * 41, "[z]", "w%d" % rng.randrange(99)]) for _ in range(rng.randrange(1, 9))]
        texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 120))))
    line = " ".join(f"l{i}" for i in range(12))
    texts += ["\n".join([line] * 30), line, (line + " x ") * 2]
    got = np.array(compute(pa.array(texts, pa.string()))).T
    assert np.allclose(got, [slow_features(t) for t in texts], atol=1e-12)
    # a line of twelve words repeated: no short lag sees it
    assert got[-3][NAMES.index("copied_share")] > 0.9 and got[-3][NAMES.index("repeat_share")] == 0


def labelled(n=3000, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(10, 80))
        bad = i % 8 == 0
        if bad and i % 16:
            w = [x + "###" for x in w]
        elif bad:
            w = [w[0]] * len(w)
        rows.append((i, " ".join(w), "en" if i % 3 else "xx", "s0"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_keeps_good_and_rejects_bad(spark):
    rows, labels = labelled(6000)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.is_kept for r in quality_verdicts(frame(spark, rows), lab).collect()}
    good = [kept[i] for i, q, _ in labels if q]
    bad = [kept[i] for i, q, _ in labels if not q]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.05


def test_cutoffs_like_brute_force(spark):
    rows, labels = labelled(1500)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    grid = {"symbol_share": [0.5, 0.3, 0.1, 0.0]}
    scored, cut = fit(frame(spark, rows), lab, grid=grid, risk=0.02)
    f = {r.doc_id: (r.lang, r.f.symbol_share) for r in scored.collect()}
    want = {}
    for s in ("en", "xx"):
        good = [f[i][1] for i, q, _ in labels if q and f[i][0] == s]
        bad = [f[i][1] for i, q, _ in labels if not q and f[i][0] == s]
        safe = []
        for c in grid["symbol_share"]:
            if upper_bound(sum(x > c for x in good), len(good), 0.05 / 2) > 0.02:
                break
            safe.append((sum(x > c for x in bad), c))
        if safe and safe[-1][0]:
            want[s] = {"symbol_share": next(c for hit, c in safe if hit == safe[-1][0])}
    assert cut == want


def test_small_holdout_rejects_nothing(spark):
    rows, labels = labelled(60)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert all(r.is_kept for r in quality_verdicts(frame(spark, rows), lab).collect())


def test_odd_rows(spark):
    rows, labels = labelled(1200)
    docs = frame(spark, rows + [(None if i is None else i + 10_000, *rest) for i, *rest in ODD])
    odd_labels = [(None, 1, 0), (5, None, None), (1, 0, 0), (1, 1, 0)]
    lab = spark.createDataFrame(labels + odd_labels, "doc_id bigint, quality int, toxic int")
    kept = quality_filter(docs, lab)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 2
    untouched(clashing(docs), quality_filter(clashing(docs), lab), kept.count())
    assert quality_filter(docs.limit(0), lab).count() == 0
    assert quality_filter(docs, lab.limit(0)).count() == docs.count()
    assert calibrate(fit(docs.limit(0), lab)[0], lab) == {}


def test_union_certified_at_full_risk(spark):
    # about 250 good documents of a language are enough for all five rules together
    rows, labels = labelled(860)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.is_kept for r in quality_verdicts(frame(spark, rows), lab).collect()}
    for lang in ("en", "xx"):
        ids = [(i, q) for (i, _, s, _), (_, q, _) in zip(rows, labels) if s == lang]
        assert 200 < sum(q for _, q in ids)
        assert not any(kept[i] for i, q in ids if not q) and sum(kept[i] for i, q in ids if q) >= 0.98 * sum(q for _, q in ids)


def test_small_and_unlabelled_strata_use_the_pool(spark):
    rows, labels = labelled(3000)
    few = [(50_000 + i, t, "yy", s) for i, t, _, s in rows[:40]]
    none = [(60_000 + i, t, "zz", s) for i, t, _, s in rows[:40]]
    odd = [(70_000 + i, t.replace("w", "w####") if i % 8 else t, "qq", s) for i, t, _, s in rows[:16]]
    more = [(50_000 + i, q, t) for i, q, t in labels[:40]] + [(70_000 + i, q, t) for i, q, t in labels[:16]]
    docs, lab = frame(spark, rows + few + none + odd), spark.createDataFrame(labels + more, "doc_id bigint, quality int, toxic int")
    scored, cut = fit(docs, lab)
    assert cut.other and cut["yy"] == cut.other and "zz" not in cut
    kept = {r.doc_id: r.is_kept for r in quality_verdicts(docs, lab).collect()}
    for base in (50_000, 60_000):
        assert [kept[base + i] for i in range(40)] == [i % 8 > 0 for i in range(40)]
    # its own good documents speak against the pooled symbol cutoff
    assert all(kept[70_000 + i] for i in range(16) if i % 8)


def test_sequence_by_hand():
    # rule 0 has more to gain first; a document caught by one rule is no gain of another
    bad = Counter({(2, 0): 5, (1, 0): 1, (2, 1): 2, (0, 1): 3, (0, 0): 4})
    steps = sequence(bad, Counter({(0, 0): 9}), [2, 2])
    assert steps == [(1, 2), (1, 0), (0, 0)]
    # where it costs good documents, the other rule comes first
    assert sequence(bad, Counter({(2, 0): 1}), [2, 2]) == [(2, 0), (1, 0), (0, 0)]
    good = Counter({(0, 0): 90, (1, 0): 10})
    assert certified(steps, good, lambda wrong, n: wrong <= 5) == (1, 0)
    assert certified(steps, good, lambda wrong, n: False) is None
