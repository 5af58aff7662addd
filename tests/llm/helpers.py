"""Small corpora for the tests of this folder."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows):
    """documents of (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *("en", "s0")[len(r) - 2 :])
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=1, n=60):
    """Documents with exact copies, near copies, shared passages and junk."""
    rng = random.Random(seed)
    rows = []
    passage = " ".join(words(rng, 60))
    for i in range(n):
        w = words(rng, rng.randrange(30, 300))
        if i % 7 == 3:
            w = rows[-1][1].split()
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        text = " ".join(w)
        if i % 11 == 5:
            text = rows[rng.randrange(len(rows))][1]
        if i % 9 == 4:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        rows.append((i, text, rng.choice(["en", "de", "fr"]), f"s{rng.randrange(4)}"))
    return rows


#: Rows every operator must take: nulls in every column, empty and blank texts,
#: ties, repeated rows and a very long text.
ODD = [
    (None, None, None, None),
    (1, None, "en", "s0"),
    (2, "", "en", "s0"),
    (3, " \n\t ", None, "s1"),
    (4, "one", "de", None),
    (5, "same text here with some words in it", "en", "s0"),
    (6, "same text here with some words in it", "en", "s0"),
    (6, "same text here with some words in it", "en", "s0"),
    (None, "same text here with some words in it", "en", "s0"),
    (7, "long " + " ".join(f"t{i % 9973}" for i in range(60_000)), "en", "s2"),
    (8, "é ü 漢字 🙂 " * 5, "fr", "s2"),
]


def clashing(df):
    """Extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    for name in NAMES:
        df = df.withColumn(name, F.lit("clash"))
    return df


NAMES = ("tokens", "topic", "weight", "p", "is_kept", "keep_id", "copies", "group_id", "group_size", "shard", "bin", "key", "n", "rk", "features", "f", "id", "line_no", "score")
NAMES += ("__fp", "__twice", "__key", "__f", "__topic", "__p", "__is_kept", "__keep_id", "a b.c")


def untouched(before, after, count):
    """Columns, types and the values of clashing columns are as given."""
    assert after.dtypes == before.dtypes
    rows = after.collect()
    assert len(rows) == count
    assert all(r[n] == "clash" for r in rows for n in NAMES)
