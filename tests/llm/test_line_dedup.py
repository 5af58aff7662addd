import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm.line_dedup import MIN_LINE, MIN_NEAR, duplicate_lines, within_one_edit

from .helpers import ODD, clashing, frame, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    lines = []
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            w = tuple(line.split())
            if len(w) >= MIN_LINE:
                lines.append(((i is None, i or 0, k), i, w))
    first = {}
    for at, _, w in sorted(lines):
        first.setdefault(w, at)
    near = {}
    for w, at in first.items():
        if len(w) >= MIN_NEAR:
            near[w] = min((a for v, a in first.items() if len(v) >= MIN_NEAR and a < at and abs(len(v) - len(w)) < 2 and distance(v, w) == 1), default=None)
    out = []
    for at, i, w in lines:
        keep = near.get(w) or first[w]
        if near.get(w) or at != first[w]:
            out.append((i, at[2], None if keep[0] else keep[1], keep[2], "near" if near.get(w) else "exact"))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in duplicate_lines(df).collect()), key=str)


def lines_corpus(seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.choice([1, 3, 4, 7, 8, 9, 12, 30])) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            w = list(rng.choice(pool)) if rng.random() < 0.7 else words(rng, rng.randrange(0, 20))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                what = rng.randrange(3)
                if what == 0 and w:
                    w[min(k, len(w) - 1)] = f"z{rng.randrange(3)}"
                elif what == 1 and w:
                    del w[min(k, len(w) - 1)]
                else:
                    w.insert(k, rng.choice(["the", f"z{rng.randrange(3)}"]))
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def test_like_brute_force(spark):
    kinds = set()
    for seed in (1, 2, 3):
        rows = lines_corpus(seed)
        want = brute(rows)
        kinds |= {k for *_, k in want}
        assert result(frame(spark, rows)) == want
    assert kinds == {"near", "exact"}


def test_runs_of_one_word(spark):
    rows = [(0, "a a a a a a a a"), (1, "a a a a a a a a a"), (2, "a a a a a a a a a a"), (3, "a a a a b a a a a"), (4, "b a a a a a a a a")]
    assert result(frame(spark, rows)) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=7), st.lists(st.sampled_from("ab"), max_size=7))
def test_within_one_edit(a, b):
    assert within_one_edit(a, b) == (distance(a, b) <= 1)


def test_odd_rows(spark):
    rows = ODD + [(20, "one two three four\n\n \none two three four"), (21, None), (None, "one two three four")]
    docs = frame(spark, rows)
    want = brute(rows)
    assert result(docs) == want and (20, 3, 20, 0, "exact") in want
    assert result(clashing(docs)) == want
    assert result(docs.limit(0)) == []
