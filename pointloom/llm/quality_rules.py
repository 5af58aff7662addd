"""Quality rules with risk-controlled thresholds (operator 7).

Each rule rejects documents whose feature is above a cutoff; a document goes if
any rule rejects it. For every stratum (language) labelled holdout documents
decide the cutoffs of all rules together. The documents labelled bad and a
tenth of those labelled good give one sequence of ever tighter cutoffs: each
step tightens a rule to the loosest cutoff that gains a bad document, first the
rule that costs least of these good documents, of several the one with most bad
documents still to gain. (One rule alone has no order to find and needs no
tenth.) The other good documents, which had no part in the order, test it step
by step with the exact (Clopper-Pearson) upper bound on the share of good
documents that the union of the rules would reject; the sequence stops at the
first step that cannot be shown to be within the allowed risk. Fixed-sequence testing needs no
correction inside a sequence; across strata the error level is divided by
their number (Bonferroni), so with probability 1 - delta no tested stratum
loses more than `risk` of its good documents.

A stratum with too few good documents to show that for any cutoff, or with no
labels at all, uses cutoffs certified on all labelled documents together, as
far as no more than `risk` of its own good ones go. These hold for the mix of
languages, not for such a stratum by itself.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, stored
from .features import features

#: Candidate cutoffs of each rule, from loose to tight.
GRID = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.17, 0.14, 0.12, 0.1, 0.09, 0.08, 0.07, 0.06, 0.05, 0.04, 0.03, 0.02],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.17, 0.15],
    "repeat_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1],
    "copied_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "digit_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "long_word_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
RISK, DELTA = 0.02, 0.05
#: One of so many good documents, by hash, is for the order of the rules.
DESIGN = 10


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed from k downwards until terms no longer
    count: for k below the mean a few standard deviations' worth of terms."""
    lp, lq, base = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    total, low = 0.0, p * n
    for i in range(k, -1, -1):
        term = math.exp(base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq)
        total += term
        if i < low and term < 1e-18 * total:
            break
    return min(1.0, total)


def within_risk(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the Clopper-Pearson bound of k of n is at most `risk`: one tail,
    and none where the share itself is above it."""
    return n > 0 and k <= risk * n and at_most(k, n, risk) <= error


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the p at which Binomial(n, p) <= k has probability
    `error`; 1 for n = 0."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and at_most(k, n, mid) > error:
            low = mid
        else:
            high = mid
    return high


class Cutoffs(dict):
    """Cutoffs by stratum and rule; `other` has those of strata without labels."""

    other: dict[str, float] = {}


def sequence(bad: Counter, design: Counter, lengths: list[int]) -> list[tuple[int, ...]]:
    """Ever tighter cutoffs, from documents labelled bad and the good ones set
    apart. Both are counted by the number of cutoffs that each rule's feature
    exceeds; a step has the index of each rule's cutoff in ascending order, its
    length for none."""
    steps, now = [], tuple(lengths)
    while left := {v: n for v, n in bad.items() if any(v) and not rejects(now, v)}:
        choice = []
        for r in range(len(now)):
            if gain := sum(n for v, n in left.items() if v[r]):
                step = (*now[:r], max(v[r] for v in left) - 1, *now[r + 1 :])
                choice.append((sum(n for v, n in design.items() if rejects(step, v)), -gain, r, step))
        now = min(choice)[-1]
        steps.append(now)
    return steps


def rejects(step: Sequence[int], above: tuple[int, ...]) -> bool:
    return any(a > i for a, i in zip(above, step))


def certified(steps: list[tuple[int, ...]], good: Counter, safe: Callable[[int, int], bool]) -> tuple[int, ...] | None:
    """The last step before the first that is not safe(rejected, all)."""
    found, n = None, sum(good.values())
    for step in steps:
        if not safe(sum(m for v, m in good.items() if rejects(step, v)), n):
            break
        found = step
    return found


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, __good): one row for each labelled document, good if any of its
    labels says so; null ids and labels are ignored."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("__good"))


def calibrate(scored: DataFrame, labels: DataFrame, stratum: str = "lang", grid: dict = GRID, risk: float = RISK, delta: float = DELTA) -> Cutoffs:
    """Cutoffs by stratum and rule, from the labelled rows of `scored`
    (doc_id, stratum, struct f). A stratum without documents labelled bad tests
    the sequence of all strata's."""
    known = labelled(labels)
    held = scored.where("doc_id is not null").join(known, "doc_id")
    key = F.coalesce(stratum, F.lit(""))
    # how many cutoffs of each rule a document exceeds; one row per combination that occurs
    above = F.array(*[sum(((F.col(f"f.{r}") > c).cast("int") for c in cuts), F.lit(0)) for r, cuts in grid.items()])
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(DESIGN)) == 0 if len(grid) > 1 else F.lit(False)
    role = F.when(F.col("__good") != 1, "bad").when(apart, "design").otherwise("good")
    counts = held.select(key.alias("s"), role.alias("role"), above.alias("above")).groupBy("s", "role", "above").count().collect()
    strata: dict[str, dict[str, Counter]] = {}
    both: dict[str, Counter] = defaultdict(Counter)
    for s, kind, v, n in counts:
        strata.setdefault(s, defaultdict(Counter))[kind][tuple(v)] += n
        both[kind][tuple(v)] += n
    found, lengths = Cutoffs(), [len(cuts) for cuts in grid.values()]
    if not strata:
        return found
    # the pooled test takes the place of a small stratum's own, or is one more
    tests = len(strata) + (not scored.where(~key.isin(list(strata))).isEmpty())
    safe = lambda wrong, n: within_risk(wrong, n, risk, delta / tests)
    named = lambda step: {r: sorted(cuts)[i] for (r, cuts), i in zip(grid.items(), step or lengths) if i < len(cuts)}
    general = sequence(both["bad"], both["design"], lengths)
    pooled = certified(general, both["good"], safe)
    upto = general[: general.index(pooled) + 1] if pooled else []
    found.other = named(pooled)
    for s, by in strata.items():
        if safe(0, sum(by["good"].values())):
            step = certified(sequence(by["bad"], by["design"], lengths) or general, by["good"], safe)
        else:
            step = certified(upto, by["good"] + by["design"], lambda wrong, n: wrong <= risk * n)
        found[s] = named(step)
    return found


def broken(cutoffs: Cutoffs, stratum: str, f: str) -> Column:
    """The names of the rules that a row breaks, as an array. Strata that the
    labels have but the cutoffs don't are kept whole; see `Cutoffs`."""
    every = sorted({r for rules in [*cutoffs.values(), cutoffs.other] for r in rules})
    out = []
    for rule in every:
        known = F.create_map(*[F.lit(x) for s, rules in cutoffs.items() for x in (s, float(rules.get(rule, math.inf)))]) if cutoffs else None
        other = F.lit(float(cutoffs.other.get(rule, math.inf)))
        own = F.coalesce(known[F.coalesce(F.col(stratum), F.lit(""))], other) if cutoffs else other
        out.append(F.when(F.col(f"{f}.{rule}") > own, F.lit(rule)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def fit(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, Cutoffs]:
    """Features of all documents (stored), and the cutoffs."""
    scored = stored(docs.select("doc_id", "lang", features().alias("f")), "features")
    return scored, calibrate(scored, labels, **options)


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, lang, broken, is_kept) of every row of docs.

    Texts that are null, empty or blank have all features zero and are kept
    (no rule is broken); so is any row whose stratum has no certified cutoff,
    neither its own nor a pooled one. Very long texts are read whole. A feature
    equal to its cutoff does not break the rule. A null language is a stratum
    of its own. Repeated rows get equal verdicts. Extra columns are ignored,
    whatever their names; an empty table gives an empty table.
    """
    scored, cutoffs = fit(docs, labels, **options)
    names = broken(cutoffs, "lang", "f")
    return scored.select("doc_id", "lang", F.array_join(names, ",").alias("broken"), (F.size(names) == 0).alias("is_kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that break no rule, all columns as given, whatever
    their names; which rows, and what nulls, empty and long texts, ties,
    repeated rows and empty tables give, is as in quality_verdicts."""
    # stored with their features: one pass over the texts, and none of them is shuffled
    (f,) = fresh(docs, "f")
    scored = stored(docs.withColumn(f, features()), "scored")
    cutoffs = calibrate(scored.select("doc_id", "lang", F.col(f).alias("f")), labels, **options)
    return scored.where(F.size(broken(cutoffs, "lang", f)) == 0).select(*map(column, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
