"""Mixing sources to target weights (operator 2).

Tokens are counted by (source, language, topic). Iterative proportional fitting
rakes the cell totals to the target shares of the three margins in turn; the
raked over the observed total is the cell's weight. Documents are kept with
probability min(1, rate * weight), the rate chosen so that the expected tokens
are KEEP of all, by a hash of the document that any engine can repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, stored, tokens, unit_hash

#: Topics by pattern, first match wins; the rest is "prose".
TOPICS = {"legal": "[Ll]icen[sc]e|LICEN[SC]E|[Cc]opyright|[Rr]ights reserved", "records": "[0-9]{3}[-.][0-9]{2,3}[-.]|[0-9]{13,}|[a-z0-9]@[a-z]", "tabular": " \\| "}
MARGINS = ("source", "lang", "topic")
#: Target shares: a table {value: share}, or a power that tempers the observed shares.
TARGETS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS, KEEP, SEED = 25, 0.8, ":mix"


def topic(text: str = "text", topics: dict[str, str] = TOPICS) -> Column:
    """Topic of a text by the first pattern found; null and empty are prose."""
    out = F.lit("prose")
    for name, pattern in reversed(topics.items()):
        out = F.when(F.col(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def shares(value: pd.Series, total: np.ndarray, target: dict | float) -> dict:
    """Target share of each value present; values missing from a table get
    none, and what is left is scaled to one."""
    by = pd.Series(total).groupby(value.to_numpy()).sum()
    want = pd.Series({k: float(target.get(k, 0.0)) for k in by.index}) if isinstance(target, dict) else (by / max(by.sum(), 1e-300)) ** target
    return (want / want.sum()).to_dict() if want.sum() > 0 else want.to_dict()


def rake(cells: pd.DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, keep: float = KEEP) -> pd.DataFrame:
    """Cells (margins, total) with `weight` and `p`. Cells of no tokens, and
    cells of a value whose target is zero, have weight 0."""
    total = cells["total"].to_numpy(float)
    fitted, grand = total.copy(), total.sum()
    goals = {m: cells[m].map(shares(cells[m], total, targets[m])).to_numpy(float) * grand for m in MARGINS}
    for _ in range(rounds):
        for m in MARGINS:
            now = pd.Series(fitted).groupby(cells[m].to_numpy()).transform("sum").to_numpy()
            fitted = np.where(now > 0, fitted * goals[m] / np.where(now > 0, now, 1), 0)
    weight = np.divide(fitted, total, out=np.zeros_like(total), where=total > 0)
    order = np.argsort(-weight, kind="stable")
    capped = np.concatenate([[0], np.cumsum(total[order])])
    free = np.concatenate([np.cumsum((total * weight)[order][::-1])[::-1], [0]])
    rate = np.inf
    for k in range(len(order)):
        if free[k] <= 0:
            break
        rate = (keep * grand - capped[k]) / free[k]
        if rate * weight[order[k]] <= 1:
            break
    p = np.where(weight > 0, np.minimum(1.0, np.where(weight > 0, weight, 1) * rate), 0.0)
    return cells.assign(weight=weight, p=p)


def fitted_cells(rows: DataFrame, names: list[str], targets: dict = TARGETS, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, weight, p) from rows with source, lang, topic and
    tokens in the columns `names`.

    The corpus is reduced to cells by a partial aggregate first; raking works
    on the cells alone, in one task: their number is that of the combinations
    of source, language and topic that occur, not of documents.
    """
    cells = rows.groupBy(*[F.col(n).alias(m) for n, m in zip(names, MARGINS)]).agg(F.sum(names[3]).cast("double").alias("total"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        done = rake(part.sort_values(list(MARGINS), ignore_index=True), targets, rounds, keep)
        return done[[*MARGINS, "weight", "p"]]

    return cells.groupBy().applyInPandas(run, "source string, lang string, topic string, weight double, p double")


def _drawn(docs: DataFrame, names: list[str], carry: list[str], targets: dict, topics: dict[str, str], keep: float, seed: str) -> DataFrame:
    """The columns `carry` of docs and topic, tokens, weight, p and is_kept in
    five columns called as given.

    Patterns are matched once: topics and tokens are stored with the columns
    carried, then raking and the draw read that table.
    """
    kind, size, weight, p, kept = names
    source, lang, draw = fresh(docs.withColumns({n: F.lit(0) for n in names}), "source", "lang", "draw")
    chance = unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")), seed)
    made = {source: F.coalesce("source", F.lit("")), lang: F.coalesce("lang", F.lit("")), kind: topic("text", topics), size: tokens(), draw: chance}
    rows = stored(docs.select(*map(column, carry), *[c.alias(n) for n, c in made.items()]), "topics")
    cells = stored(fitted_cells(rows, [source, lang, kind, size], targets, ROUNDS, keep), "cells").toDF(source, lang, kind, weight, p)
    return rows.join(cells, [source, lang, kind], "left").withColumn(kept, F.col(draw) < F.col(p)).select(*map(column, carry), *names)


def sampled(docs: DataFrame, targets: dict = TARGETS, topics: dict[str, str] = TOPICS, keep: float = KEEP, seed: str = SEED, columns: list[str] | None = None) -> DataFrame:
    """docs (all its columns, or those named) with topic, tokens, weight, p and
    is_kept.

    Null sources and languages are the value "". A null or empty text has no
    tokens and is prose; its cell may have weight 0, then it is not kept. Texts
    of any length are matched whole. The draw depends on the id and, where that
    is null, on the text, so repeated rows share their fate. Cells of equal
    weight are treated alike. Other columns pass through; columns of the five
    names are replaced. An empty table gives an empty table.
    """
    names = ["topic", "tokens", "weight", "p", "is_kept"]
    docs = docs.drop(*names)
    return _drawn(docs, names, columns or docs.columns, targets, topics, keep, seed)


def mix(docs: DataFrame, targets: dict = TARGETS, topics: dict[str, str] = TOPICS, keep: float = KEEP, seed: str = SEED) -> DataFrame:
    """The documents drawn, all columns as given, whatever their names; which
    documents, and what nulls, empty and long texts, ties, repeated rows and
    empty tables give, is as in sampled."""
    names = fresh(docs, "topic", "tokens", "weight", "p", "is_kept")
    return _drawn(docs, names, docs.columns, targets, topics, keep, seed).where(F.col(names[4])).select(*map(column, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return sampled(docs, columns=["doc_id"]).select("doc_id", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "is_kept")


def _sql() -> str:
    """The same in SQL, raking unrolled; defaults only."""
    kinds = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS.items()) + " ELSE 'prose' END"
    parts = [
        f"rows AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce({kinds}, 'prose') AS topic, coalesce(ceil(strlen(text) / 4.0), 0)::BIGINT AS tokens FROM documents)",
        "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS total, sum(tokens)::DOUBLE AS x FROM rows GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"g_{m} AS (SELECT {m}, s / sum(s) OVER () AS share FROM (SELECT {m}, power(sum(total) / (SELECT sum(total) FROM c0), {TARGETS[m]}) AS s FROM c0 GROUP BY {m}))")
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, total, CASE WHEN sum(x) OVER (PARTITION BY {m}) > 0 THEN x * share * (SELECT sum(total) FROM c0) / sum(x) OVER (PARTITION BY {m}) ELSE 0 END AS x FROM c{k} JOIN g_{m} USING ({m}))")
            k += 1
    parts += [
        f"w AS (SELECT source, lang, topic, total, CASE WHEN total > 0 THEN x / total ELSE 0 END AS weight FROM c{k})",
        "o AS (SELECT *, coalesce(sum(total) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(total * weight) OVER (ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w WHERE weight > 0)",
        f"r AS (SELECT ({KEEP} * (SELECT sum(total) FROM c0) - capped) / free AS rate FROM o WHERE ({KEEP} * (SELECT sum(total) FROM c0) - capped) / free * weight <= 1 ORDER BY weight DESC LIMIT 1)",
        "p AS (SELECT source, lang, topic, weight, CASE WHEN weight > 0 THEN least(1.0, weight * (SELECT rate FROM r)) ELSE 0 END AS p FROM w)",
    ]
    draw = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '') || '{SEED}'), 1, 13))::BIGINT / 4503599627370496.0"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, topic, tokens, round(weight, 6) AS weight, round(p, 6) AS p, {draw} < p AS is_kept FROM rows JOIN p USING (source, lang, topic)"


SQL = _sql()
