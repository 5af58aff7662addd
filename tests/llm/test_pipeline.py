"""The pipeline against its stages done by brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import mixing, quality_rules

from .helpers import NAMES, ODD, clashing, frame, words
from .test_near_dedup import brute


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def corpus(n=3000):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 60), 50_000)
        bad = i % 10 == 0
        if bad:
            w = [x + "$$$" for x in w]
        text = " ".join(w)
        if not bad and i % 17 == 0:
            text = rows[i - 1][1] if (i - 1) % 10 else rows[i - 2][1]
        if not bad and i % 23 == 0:
            w = (rows[i - 1][1] if (i - 1) % 10 else rows[i - 2][1]).split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        rows.append((i, text, "en", f"s{i % 5 if i % 2 else 0}"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_like_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = frame(spark, rows)
    tables(spark, tmp_path, docs, labels)
    stage = docs
    # 1: cutoffs as fitted; features are tested on their own
    scored, cut = quality_rules.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert cut
    feats = {r.doc_id: (r.lang, r.f.asDict()) for r in scored.collect()}
    kept = [r for r in rows if not any(feats[r[0]][1][k] > c for k, c in cut.get(feats[r[0]][0], {}).items())]
    assert not any(r[0] % 10 == 0 for r in kept) and len(kept) > 2600
    # 2
    seen, unique = set(), []
    for r in sorted(kept):
        if r[1] not in seen:
            seen.add(r[1])
            unique.append(r)
    assert len(unique) < len(kept)
    # 3, on candidates by shared words to spare the pairs
    group = {}
    by_word: dict[str, list] = {}
    for r in unique:
        for w in set(r[1].split()):
            by_word.setdefault(w, []).append(r)
    near = {r[0] for v in by_word.values() if 1 < len(v) for r in v}
    sub = [r for r in unique if r[0] in near]
    parts: dict[int, list] = {}
    for r in sub:
        parts.setdefault(len(r[1].split()), []).append(r)
    for part in parts.values():
        group |= brute(part)
    leads = [r for r in unique if group.get(r[0], r[0]) == r[0]]
    assert len(leads) < len(unique)
    # 4: the same raking on the brute-force survivors
    draw = mixing.sampled(frame(spark, leads)).where("is_kept")
    want = {r.doc_id for r in draw.select("doc_id").collect()}
    assert 0.6 < len(want) / len(leads) < 0.95
    # 5
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == want
    size = {r[0]: -(-len(r[1].encode()) // 4) for r in leads}
    assert out.groupby("doc_id").tokens.sum().to_dict() == {i: size[i] for i in want}
    assert out.groupby(["shard", "bin"]).tokens.sum().max() <= 2048
    assert stage.count() == len(rows)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    rows, labels = corpus(400)
    docs = clashing(frame(spark, rows + [(None if i is None else i + 10_000, *rest) for i, *rest in ODD]))
    tables(spark, tmp_path, docs, labels)
    kinds = docs.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == kinds
        rows = docs.collect()
        assert len(rows) > 200 and all(r[n] == "clash" for r in rows for n in NAMES)
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
    assert docs.where(F.col("doc_id") == 10_007).count() <= 1


def test_empty(spark, tmp_path):
    rows, labels = corpus(20)
    tables(spark, tmp_path, frame(spark, rows).limit(0), labels)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
