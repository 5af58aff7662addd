"""Quality classifier with hierarchical empirical Bayes (operator 9).

A logistic regression on document features, fitted on at most SAMPLE labelled
documents, gives each document's own evidence. Sites add theirs: a document
counts by its label where it has one and by its own evidence elsewhere; the
host's share of good documents is a Beta posterior around the global prior,
whose strength is estimated from the spread between hosts; a path's is a Beta
posterior around its host, with a strength estimated from the spread inside
hosts. Sparse sites stay near their parent. A document is left out of its own
sites' posteriors, so no evidence counts twice. The site's log odds shift the
document's.

Hosts and paths are columns of the caller's choice. The test tables' documents
have no URL: there the source stands for the host and the language for the path.

Sites are sums over grouped documents, so a host of any size is a partial
aggregate and one small row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored
from .features import NAMES, features
from .quality_rules import labelled

SAMPLE = 20_000
CUTOFF, SITE_WEIGHT = 0.5, 0.5
#: Strengths of the priors in documents are kept inside these.
STRENGTH = (2.0, 1000.0)
#: Knots of the linear splines each feature is expanded to.
KNOTS = {"symbol_share": [0, 0.02, 0.08], "upper_share": [0, 0.1, 0.3], "repeat_share": [0, 0.08, 0.2], "copied_share": [0, 0.1, 0.3], "digit_share": [0, 0.1], "long_word_share": [0, 0.1], "log_words": [0, 3, 5]}


def basis(f: str) -> list[Column]:
    return [F.greatest(F.lit(0.0), F.col(f"{f}.{n}") - F.lit(float(k))) for n in NAMES for k in KNOTS[n]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Intercept and weights by Newton's method with a ridge on standardised columns."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    penalty = np.full(z.shape[1], ridge * len(x))
    penalty[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - (w[1:] * mean / sd).sum()), w[1:] / sd


def trained(scored: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, np.ndarray]:
    """The regression on at most `sample` labelled documents, drawn by hash. Of
    rows with one id the one with the smallest features stands for all. Without
    documents of both kinds it is the constant 1/2 (or the one kind)."""
    drawn = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = scored.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.array(*basis("f"))).alias("x"), F.max("__good").alias("y")).orderBy("doc_id").toPandas()
    size = sum(len(KNOTS[n]) for n in NAMES)
    if not len(rows) or rows.y.nunique() < 2:
        share = (rows.y.sum() + 1) / (len(rows) + 2)
        return float(np.log(share / (1 - share))), np.zeros(size)
    return fit_logistic(np.vstack(rows.x.to_numpy()), rows.y.to_numpy(float))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def classified(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, sample: int = SAMPLE, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, p_doc, p_host, p_path, p_good, is_good) of every row.

    Null hosts and paths are sites of their own. Null, empty and blank texts
    have all features zero and are judged by them and their site. Very long
    texts are read whole. A p_good equal to the cutoff is good. Repeated rows
    count as often as they occur; a row that is alone at its site has its
    parent's share. Extra columns are ignored, whatever their names; an empty
    table gives an empty table.
    """
    raw = stored(docs.select("doc_id", F.coalesce(column(host), F.lit("")).alias("host"), F.coalesce(column(path), F.lit("")).alias("path"), features().alias("f")), "features")
    bias, weights = trained(raw, labels, sample)
    z = F.lit(bias)
    for w, b in zip(weights, basis("f")):
        z = z + F.lit(float(w)) * b
    known = labelled(labels).withColumnRenamed("__good", "y")
    scored = raw.join(known, "doc_id", "left").select("doc_id", "host", "path", (1 / (1 + F.exp(-z))).alias("p_doc"), F.col("y").cast("double").alias("y"))
    scored = stored(scored.withColumn("e", F.coalesce("y", "p_doc")), "evidence")
    paths = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("e").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    total = hosts.agg(F.sum("hn"), F.sum("hgood")).first()
    top = (total[1] / total[0]) if total[0] else 0.5

    def strength(groups: DataFrame, n: str, mean: Column, parent: Column) -> float:
        """Strength of a Beta prior by moments: how far the groups' means
        spread around their parents beyond what their sizes explain."""
        within = parent * (1 - parent) / F.col(n)
        got = groups.where(F.col(n) > 1).agg(F.avg((mean - parent) ** 2 - within), F.avg(parent * (1 - parent)), F.count(F.lit(1))).first()
        if got[2] < 2:
            return STRENGTH[1]
        return float(np.clip(got[1] / got[0] - 1 if got[0] > 0 else STRENGTH[1], *STRENGTH))

    a = strength(hosts, "hn", F.col("hgood") / F.col("hn"), F.lit(top))
    sites = paths.join(hosts, "host")
    b = strength(sites, "n", F.col("good") / F.col("n"), (F.col("hgood") + a * top) / (F.col("hn") + a))
    # the document itself left out
    p_host = (F.col("hgood") - F.col("e") + a * top) / (F.col("hn") - 1 + a)
    p_path = (F.col("good") - F.col("e") + b * F.col("p_host")) / (F.col("n") - 1 + b)
    final = logit(F.col("p_doc")) + SITE_WEIGHT * (logit(F.col("p_path")) - logit(F.lit(top)))
    out = scored.join(sites, ["host", "path"]).withColumn("p_host", p_host).withColumn("p_path", p_path).withColumn("p_good", 1 / (1 + F.exp(-final)))
    return out.select("doc_id", "host", "path", "p_doc", "p_host", "p_path", "p_good", (F.col("p_good") >= cutoff).alias("is_good"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
