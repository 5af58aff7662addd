import math

import numpy as np

from pointloom.llm.quality_classifier import SITE_WEIGHT, classified, fit_logistic

from .helpers import ODD, clashing, frame
from .test_quality_rules import labelled


def test_logistic_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 3)) * [1, 5, 0.1]
    p = 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.2, 4.0])))
    b, w = fit_logistic(x, (rng.random(20_000) < p).astype(float), ridge=1e-6)
    assert abs(b - 0.3) < 0.1 and np.allclose(w, [1.0, -0.2, 4.0], atol=0.4)


def sites(spark, n=2400):
    rows, labels = labelled(n)
    rows = [(i, t, lang, f"host{i % 3}" if i % 100 else "tiny") for i, t, lang, _ in rows]
    return rows, labels, frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels, docs, lab = sites(spark)
    out = {r.doc_id: r for r in classified(docs, lab.where("doc_id < 1600")).collect()}
    held = [(out[i].is_good, q == 1) for i, q, _ in labels if i >= 1600]
    assert sum(a == b for a, b in held) / len(held) >= 0.97
    assert sum(a for a, b in held if b) / sum(b for _, b in held) >= 0.98


def test_posteriors_like_brute_force(spark):
    _, labels, docs, lab = sites(spark)
    out = classified(docs, lab.where("doc_id % 3 = 0")).toPandas()
    # labels where there are any, a document's own evidence elsewhere
    good = {i: float(q) for i, q, _ in labels if i % 3 == 0}
    e = np.array([good.get(r.doc_id, r.p_doc) for r in out.itertuples()])
    top = e.mean()

    def strength(n, mean, parent):
        ok = n > 1
        n, mean, parent = n[ok], mean[ok], parent[ok]
        between = ((mean - parent) ** 2 - parent * (1 - parent) / n).mean()
        base = (parent * (1 - parent)).mean()
        return float(np.clip(base / between - 1 if between > 0 else 1000.0, 2.0, 1000.0))

    host, path = out.host.to_numpy(), (out.host + "/" + out.path).to_numpy()
    hosts = {h: e[host == h] for h in set(host)}
    paths = {p: e[path == p] for p in set(path)}
    sizes = lambda g: np.array([len(v) for v in g.values()], float)
    means = lambda g: np.array([v.mean() for v in g.values()])
    a = strength(sizes(hosts), means(hosts), np.full(len(hosts), top))
    whole = {h: (v.sum() + a * top) / (len(v) + a) for h, v in hosts.items()}
    b = strength(sizes(paths), means(paths), np.array([whole[p.split("/")[0]] for p in paths]))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for i, r in enumerate(out.itertuples()):
        others = np.arange(len(e)) != i
        h, q = e[others & (host == host[i])], e[others & (path == path[i])]
        p_host = (h.sum() + a * top) / (len(h) + a)
        p_path = (q.sum() + b * p_host) / (len(q) + b)
        assert math.isclose(r.p_host, p_host, rel_tol=1e-9) and math.isclose(r.p_path, p_path, rel_tol=1e-9)
        z = odds(r.p_doc) + SITE_WEIGHT * (odds(p_path) - odds(top))
        assert math.isclose(r.p_good, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_labels_reach_the_site(spark):
    """Texts alike everywhere: only labels tell the sites apart."""
    rows = [(i, f"plain words number {i} and some more of them", "en", "good" if i % 2 else "bad") for i in range(400)]
    labels = [(i, i % 2, 0) for i in range(200)]
    out = classified(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).where("doc_id >= 200").toPandas()
    assert (out[out.host == "good"].p_good > 0.6).all() and (out[out.host == "bad"].p_good < 0.4).all()


def test_a_document_does_not_vouch_for_itself(spark):
    rows = [(i, "plain words here", "en", "s0") for i in range(50)] + [(99, "plain words here", "xx", "s0")]
    lab = [(i, i % 2, 0) for i in range(50)]
    get = lambda y: classified(frame(spark, rows), spark.createDataFrame(lab + [(99, y, 0)], "doc_id bigint, quality int, toxic int")).where("doc_id = 99").first()
    one, two = get(0), get(1)
    assert math.isclose(one.p_path, one.p_host) and abs(one.p_path - two.p_path) < 0.02


def test_odd_rows(spark):
    _, labels, docs, lab = sites(spark, 800)
    odd = frame(spark, [(None if i is None else i + 10_000, *rest) for i, *rest in ODD])
    out = classified(docs.union(odd), lab)
    assert out.count() == 800 + len(ODD)
    assert out.where("p_good is null or is_good is null").count() == 0
    assert classified(clashing(odd), lab).count() == len(ODD)
    assert classified(odd.limit(0), lab).count() == 0
    assert classified(odd, lab.limit(0)).count() == len(ODD)
