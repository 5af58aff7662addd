import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm.substring_dedup import decode, encode, repeated_spans

from .helpers import ODD, clashing, corpus, frame


def brute(rows, width):
    """Maximal runs of windows that occur more than once."""
    split = [(i, t.encode().split()) for i, t, *_ in rows if t]
    seen = {}
    for _, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, w in split:
        start = None
        for k in range(len(w) - width + 2):
            hit = k <= len(w) - width and seen[tuple(w[k : k + width])] > 1
            if hit and start is None:
                start = k
            if not hit and start is not None:
                out.append((i, start, k - 1 - start + width))
                start = None
    return sorted(out, key=str)


def spans(df, **options):
    return sorted((tuple(r) for r in repeated_spans(df, **options).collect()), key=str)


def test_like_brute_force(spark):
    for seed in (1, 7):
        rows = corpus(seed, 80)
        want = brute(rows, 40)
        assert want and spans(frame(spark, rows)) == want


def test_tight_lengths(spark):
    """Repeats of just under, at and over the least length, at all alignments;
    repeats inside one document and overlapping themselves."""
    rng = random.Random(2)
    word = lambda n, p: [f"{p}{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k, n in enumerate((8, 9, 10, 11, 30)):
        shared = word(n, f"p{k}")
        for j in range(3):
            rows.append((len(rows), " ".join(word(rng.randrange(0, 13), "a") + shared + word(rng.randrange(0, 13), "b"))))
    rows.append((len(rows), " ".join(["tick"] * 40)))
    rows.append((len(rows), " ".join(word(5, "c") + ["x", "y"] * 12)))
    twice = word(14, "d")
    rows.append((len(rows), " ".join(twice + word(3, "e") + twice)))
    assert spans(frame(spark, rows), block=5, min_words=9) == brute(rows, 9)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=80))
def test_coding(values):
    fp = np.sort(np.array(values, np.uint64))
    assert decode(encode(fp)).tolist() == fp.tolist()


def test_needs_a_whole_block(spark):
    with pytest.raises(ValueError):
        repeated_spans(frame(spark, corpus(1, 3)), block=20, min_words=38)


def test_odd_rows(spark):
    long = ODD + [(9, ODD[9][1]), (9, ODD[9][1]), (None, ODD[9][1] + " more")]
    docs = frame(spark, long)
    got = spans(docs)
    assert got == brute(long, 40)
    assert sum(i is None for i, *_ in got) == 1
    assert spans(clashing(docs)) == got
    assert spans(docs.limit(0)) == []
