"""Toxicity by a weighted finite-state pattern grammar (operator 4).

Words map to classes (insult, mild insult, threat, fight, target, object,
intent, copula, article, intensifier, negation, report, quote, other). Five
small transducers over class sequences are composed into one machine: negation
and reported speech mark the words in their scope, the target transducer marks
insults that are said of or to somebody, and the insult and threat transducers
weigh what the others have marked. Every clause of a document is scored by its
path through the machine.

A clause alone is toxic only where it matches a pattern: an insult predicated
of a target ("you are such an idiot"), addressed to one ("you idiot") or
intensified ("what an idiot"), or a threat with its target. A bare lexicon word
stays below the threshold; bare words add up over clauses, and only as far as
they are dense: in texts with fewer than one of them per SPARSE words they
count for proportionally less.

The lexicon is a seed of English, German, French and Spanish words plus insult
stems found for each language from labelled documents: prefixes of words that
documents labelled toxic hold significantly more often than others, by an exact
binomial test. At most SAMPLE labelled documents of either kind and each
language are read for it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

INSULTS = ["idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum", "imbecile", "dumbass", "asshole", "bastard", "retard", "subhuman"]
INSULTS += ["dummkopf", "trottel", "arschloch", "abschaum", "hurensohn", "vollidiot", "schwachkopf", "missgeburt", "untermensch"]
INSULTS += ["imbécile", "crétin", "connard", "connasse", "salaud", "salope", "abruti", "enculé"]
INSULTS += ["idiota", "imbécil", "estúpido", "estúpida", "gilipollas", "cabrón", "pendejo", "asqueroso", "asquerosa"]
#: Insults that are common in other senses: they need a second person, or company.
MILD = ["clown", "trash", "loser", "degenerate", "vermin", "ungeziefer", "racaille", "ordure", "escoria"]
THREATS = ["kill", "murder", "strangle", "stab", "shoot"]
THREATS += ["töten", "töte", "umbringen", "ermorden", "erschießen", "erstechen", "erwürgen"]
THREATS += ["tuer", "tuerai", "assassiner", "égorger", "étrangler", "poignarder", "massacrer"]
THREATS += ["matar", "mataré", "asesinar", "estrangular", "apuñalar"]
#: Threats only where somebody means to do it to the reader.
FIGHTS = ["hurt", "destroy", "beat", "hunt", "burn", "verprügeln", "vernichten", "frapper", "golpear", "destruir", "quemar"]
INTENTS = ["will", "i'll", "we'll", "they'll", "he'll", "she'll", "gonna", "going", "werde", "werden", "vais", "allons", "voy", "vamos"]
#: Targets that stand before the threat in German, French and Spanish, and Spanish ones at its end.
OBJECTS, CLITICS = ["dich", "euch", "te", "os"], ("te", "os")
SECOND = ["you", "you're", "youre", "u", "du", "ihr", "tu", "vous", "eres", "usted", "ustedes"]
THIRD = ["he", "he's", "she", "she's", "they", "they're", "him", "her", "them", "everyone", "er", "sie", "il", "elle", "ils", "él", "ella", "ellos"]
NEGATIONS = ["not", "never", "no", "isn't", "aren't", "wasn't", "don't", "won't", "nicht", "kein", "keine", "pas", "jamais", "nunca", "ningún"]
REPORTS = ["said", "says", "called", "calls", "quoted", "claimed", "claims", "wrote", "alleged", "sagte", "nannte", "dit", "dijo", "llamó"]
COPULAS = ["is", "are", "am", "was", "were", "be", "ist", "sind", "bist", "seid", "est", "es", "sont", "son"]
#: Contractions and verbs that are target and copula at once.
JOINED = ["you're", "youre", "they're", "he's", "she's", "eres"]
ARTICLES = ["a", "an", "the", "ein", "eine", "der", "die", "das", "un", "une", "le", "la", "una", "el"]
INTENSIFIERS = ["so", "such", "what", "very", "really", "total", "utter", "complete", "absolute", "absolutely", "fucking", "damn", "totaler", "quel", "quelle", "qué"]

#: A bare insult (strong, mild); what an intensifier, a third and a second
#: person add; a threat; what reported speech takes away. Negation takes all.
WEIGHTS = {"insult": 0.5, "mild": 0.42, "intense": 0.45, "third": 0.45, "second": 0.55, "threat": 1.5, "reported": -0.9}
#: A document is toxic if its score reaches this.
THRESHOLD = 0.9
#: Bare insults count in full from one per so many words.
SPARSE = 200
#: Labelled documents of either kind and language read for stems, and what a
#: stem needs: lengths tried, different words (or one in a share COMMON of the
#: toxic documents), precision for balanced kinds, and an occurrence at least
#: TIMES as frequent in toxic documents at error level ALPHA over all stems.
SAMPLE, STEM, FAMILY, COMMON, PRECISION, TIMES, ALPHA = 10_000, range(4, 10), 3, 0.03, 0.95, 3.0, 0.01
GAP = 3

CLASSES = ["insult", "mild", "threat", "fight", "second", "third", "joined second", "joined third", "object", "intent", "copula", "article", "intensifier", "negation", "report", "quote", "other"]
#: Classes that scopes look through.
LIGHT = ("copula", "article", "intensifier")


class Transducer:
    """A deterministic weighted finite-state transducer: step(state, symbol)
    gives (output symbol, weight, next state). All states accept."""

    def __init__(self, start: object, step: Callable[[object, str], tuple[str, float, object]]) -> None:
        self.start, self.step = start, step

    def __rshift__(self, other: "Transducer") -> "Transducer":
        """Composition: this one's output is the other's input, weights add up.
        Its arcs are made on demand, as most pairs of states never occur."""
        arcs: dict[tuple[object, str], tuple[str, float, object]] = {}

        def step(state: tuple, symbol: str) -> tuple[str, float, object]:
            arc = arcs.get((state, symbol))
            if arc is None:
                out, w, a = self.step(state[0], symbol)
                out, v, b = other.step(state[1], out)
                arc = arcs[state, symbol] = (out, w + v, (a, b))
            return arc

        return Transducer((self.start, other.start), step)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        """Output and weight of every symbol."""
        state, out = self.start, []
        for s in symbols:
            mark, w, state = self.step(state, s)
            out.append((mark, w))
        return out


def _kind(symbol: str) -> str:
    return symbol.partition("/")[0]


def _marks(symbol: str) -> str:
    return symbol.partition("/")[2]


def _hot(symbol: str) -> bool:
    return _kind(symbol) in ("insult", "mild", "threat", "fight")


def _marked(symbol: str, mark: str) -> str:
    return symbol + ("" if "/" in symbol else "/") + mark


def negation() -> Transducer:
    """Marks insults and threats up to GAP words after a negation with "n"."""

    def step(left: int, s: str) -> tuple[str, float, int]:
        if s == "negation":
            return s, 0.0, GAP
        out = _marked(s, "n") if left and _hot(s) else s
        return out, 0.0, left if _kind(s) in LIGHT else max(0, left - 1)

    return Transducer(0, step)


def reported(quoted: bool = False) -> Transducer:
    """Marks insults and threats with "r" after a verb of saying, until a
    quotation that follows it closes or the clause ends, and inside quotation
    marks. State: (verb seen, inside quotation marks)."""

    def step(state: tuple[bool, bool], s: str) -> tuple[str, float, tuple[bool, bool]]:
        said, inside = state
        if s == "report":
            return s, 0.0, (True, inside)
        if s == "quote":
            return s, 0.0, (said and not inside, not inside)
        return (_marked(s, "r") if (said or inside) and _hot(s) else s), 0.0, state

    return Transducer((False, quoted), step)


def aimed() -> Transducer:
    """Marks insults: "2" or "3" if predicated of a second or third person (a
    target, a copula within GAP words, the insult within GAP words), "2" also
    right after or before a second person, "i" after an intensifier.
    State: (person, copula seen, words left, intensifier's words left)."""

    def step(state: tuple, s: str) -> tuple[str, float, tuple]:
        person, linked, left, intense = state
        k = _kind(s)
        if person == "open" and k not in ("second", "joined second"):
            person, left = "", 0
        after = (person, linked, left - 1, max(0, intense - 1)) if left > 1 else ("", False, 0, max(0, intense - 1))
        if k in ("insult", "mild"):
            out = s
            if person and linked:
                out = _marked(out, person)
            elif person == "2" and left == GAP:
                out = _marked(out, person)
            if intense:
                out = _marked(out, "i")
            # a second person may still follow
            return out, 0.0, ("open", False, 1, 0) if "2" not in _marks(out) and "3" not in _marks(out) else ("", False, 0, 0)
        if k in ("second", "joined second"):
            out = "second/open" if person == "open" else k
            return out, 0.0, ("2", k != "second", GAP, 0)
        if k in ("third", "joined third"):
            return k, 0.0, ("3", k != "third", GAP, 0)
        if k == "copula" and person in ("2", "3"):
            return s, 0.0, (person, True, GAP, intense)
        if k == "intensifier":
            return s, 0.0, (person, linked, left, GAP)
        if k in LIGHT or k in ("negation", "quote"):
            return s, 0.0, (person, linked, left, intense)
        return s, 0.0, after

    return Transducer(("", False, 0, 0), step)


def insults(weights: dict[str, float] = WEIGHTS) -> Transducer:
    """Weighs insults by their marks; a second person right after a bare one
    adds its weight then. State: whether the last insult was struck out."""

    def step(struck: bool, s: str) -> tuple[str, float, bool]:
        k, m = _kind(s), _marks(s)
        if k in ("insult", "mild"):
            if "n" in m:
                return s, 0.0, True
            w = weights[k] + ("2" in m) * weights["second"] + ("3" in m) * weights["third"] + ("i" in m) * weights["intense"] + ("r" in m) * weights["reported"]
            return s, max(0.0, w), w <= 0
        if s == "second/open":
            return s, 0.0 if struck else weights["second"], False
        return s, 0.0, False

    return Transducer(False, step)


def threats(weights: dict[str, float] = WEIGHTS) -> Transducer:
    """Weighs threats with a target within GAP words after or an object before.
    A second person suffices for a threat, a third one needs intent within GAP
    words before; a fight needs intent and a second person.
    State: (pending verb, words left, object's words left, intent's words left)."""

    def step(state: tuple, s: str) -> tuple[str, float, tuple]:
        pending, left, ahead, meant = state
        k, m = _kind(s), _marks(s)
        fewer = (pending if left > 1 else "", max(0, left - 1), max(0, ahead - 1), max(0, meant - 1))
        if k in ("threat", "fight"):
            if "n" in m or (k == "fight" and not meant):
                return s, 0.0, ("", 0, 0, fewer[3])
            verb = k + ("+" if meant else "-") + ("r" if "r" in m else "")
            if ahead:
                return s, max(0.0, weights["threat"] + ("r" in m) * weights["reported"]), ("", 0, 0, fewer[3])
            return s, 0.0, (verb, GAP, 0, fewer[3])
        if k in ("second", "joined second", "object", "third", "joined third"):
            person = k in ("second", "joined second", "object")
            if pending and (person or pending.startswith("threat+")):
                return s, max(0.0, weights["threat"] + pending.endswith("r") * weights["reported"]), ("", 0, 0, 0)
            # an object may stand before its verb
            return s, 0.0, (*fewer[:2], GAP if k == "object" else fewer[2], fewer[3])
        if k == "intent":
            return s, 0.0, (*fewer[:3], GAP)
        return s, 0.0, state if k in LIGHT else fewer

    return Transducer(("", 0, 0, 0), step)


def grammar(weights: dict[str, float] = WEIGHTS) -> dict[bool, Transducer]:
    """The composed machine, for clauses that begin outside and inside of
    quotation marks."""
    return {q: negation() >> reported(q) >> aimed() >> insults(weights) >> threats(weights) for q in (False, True)}


Stems = dict[str, list[str]]


def lexicon(stems: list[str]) -> tuple[dict[str, str], re.Pattern]:
    """Classes by word, and the pattern that finds any insult or threat."""
    lists = (("copula", COPULAS), ("article", ARTICLES), ("intensifier", INTENSIFIERS), ("intent", INTENTS), ("third", THIRD), ("second", SECOND), ("object", OBJECTS), ("negation", NEGATIONS), ("report", REPORTS), ("fight", FIGHTS), ("threat", THREATS), ("mild", MILD), ("insult", INSULTS))
    words = {w: c for c, some in lists for w in some}
    words |= {w: f"joined {words[w]}" for w in JOINED}
    english = "|".join(re.escape(w) for w in INSULTS + MILD + THREATS + FIGHTS)
    parts = [rf"(?:{english})(?:s|{'|'.join(CLITICS)})?\b"] + [re.escape(s) for s in sorted(stems)]
    return words, re.compile(rf"\b(?:{'|'.join(parts)})", re.IGNORECASE)


def sieve(stems: list[str]) -> str:
    """A pattern for Arrow's linear-time matcher that every text with a lexicon
    word matches. Its word borders know ASCII letters only, so it lets a few
    more through; the lexicon's own pattern decides on these."""
    words = sorted({*INSULTS, *MILD, *THREATS, *FIGHTS, *stems})
    latin = "|".join(re.escape(w) for w in words if w[0].isascii())
    other = "".join("|" + re.escape(w) for w in words if not w[0].isascii())
    return f"(?i)(?:(?:^|[^a-zA-Z])(?:{latin}){other})"


_CLAUSE = re.compile(r"([.!?;:\n\r]+|,\s)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]")
_QUOTES = '"“”«»'


def symbols_of(clause: str, words: dict[str, str], stems: tuple[str, ...]) -> list[str]:
    """The classes of a clause's words."""
    out = []
    for w in _WORD.findall(clause.lower()):
        w = w.replace("’", "'")
        if w.startswith("t'") and w[2:] in words:
            out.append("object")
            w = w[2:]
        c = words.get(w)
        if c is None and (verb := next((words[w[: -len(e)]] for e in CLITICS if w.endswith(e) and words.get(w[: -len(e)]) in ("threat", "fight")), None)):
            out += [verb, "object"]
            continue
        if c is None and w[-1] == "s" and words.get(w[:-1]) in ("insult", "mild", "threat", "fight"):
            c = words[w[:-1]]
        if c is None:
            c = "insult" if stems and w.startswith(stems) else "quote" if w in _QUOTES else "other"
        out.append(c)
    return out


def score_text(text: str, machine: dict[bool, Transducer], words: dict[str, str], stems: tuple[str, ...]) -> tuple[float, int]:
    """The document's score, and how many clauses have a part in it."""
    total, clauses, alone, bare, size, quoted = 0.0, 0, 0, 0.0, 0, False
    for clause in _CLAUSE.split(text):
        if "\n" in clause or "\r" in clause:
            quoted = False
        symbols = symbols_of(clause, words, stems)
        size += len(symbols)
        if any(_hot(s) for s in symbols):
            part, before = 0.0, alone
            for mark, w in machine[quoted].run(symbols):
                if _kind(mark) in ("insult", "mild") and 0 < w and not set(_marks(mark)) & set("23i"):
                    alone, bare = alone + 1, bare + w
                elif w > 0:
                    part += w
            total += part
            clauses += part > 0 or alone > before
        if sum(s == "quote" for s in symbols) % 2:
            quoted = not quoted
    return total + bare * min(1.0, alone * SPARSE / max(size, 1)), clauses


def at_least(b: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= b)."""
    lp, lq = math.log(p), math.log1p(-p)
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(b, n + 1)))


def stems_from(rows: DataFrame) -> Stems:
    """Insult stems by language from (lang, text, toxic).

    Counted are pairs of a document and a different word. A stem's share of
    the toxic documents' pairs must be TIMES its share of the others' by an
    exact binomial test, at ALPHA over the number of stems tried in the
    language: so what counts as enough support follows from how many labelled
    documents the language has. Stems also need PRECISION for balanced kinds
    and a family of FAMILY different words of toxic documents or to be one word
    of a share COMMON of these, so that words of copies of one toxic document
    are none. Of stems that begin alike the shortest stay.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        known = re.compile("|".join(map(re.escape, INSULTS + MILD)))
        for batch in batches:
            for lang, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                kind = int(toxic == 1)
                tally[lang, "", kind] += 1
                tally.update((lang, w, kind) for w in {w for w in _WORD.findall(text.lower()) if len(w) >= STEM[0] and not known.match(w)})
        keys = list(tally)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([tally[k] * k[2] for k in keys], pa.int64()), pa.array([tally[k] * (1 - k[2]) for k in keys], pa.int64())], ["lang", "word", "bad", "good"])

    sums = F.sum("bad").alias("bad"), F.sum("good").alias("good")
    by = stored(rows.select("lang", "text", "toxic").mapInArrow(count, "lang string, word string, bad bigint, good bigint").groupBy("lang", "word").agg(*sums), "words")
    prefixes = F.array_distinct(F.array(*[F.substring("word", 1, k) for k in STEM]))
    stems = by.where("word <> ''").select("lang", F.explode(prefixes).alias("stem"), "bad", "good").groupBy("lang", "stem").agg(*sums, F.count(F.when(F.col("bad") > 0, 1)).alias("family"))
    stems = stored(stems.where("bad > 0"), "stems")
    docs = {r.lang: r.bad for r in by.where("word = ''").collect()}
    pairs = {r.lang: r for r in by.where("word <> ''").groupBy("lang").agg(*sums).collect()}
    tried = {r["lang"]: r["count"] for r in stems.groupBy("lang").count().collect()}
    known = {k: r for k, r in pairs.items() if r.bad and r.good}
    if not known:
        return {}
    at = lambda f: F.create_map(*[F.lit(x) for k, r in known.items() for x in (k, float(f(k, r)))])[F.col("lang")]
    rate = (F.col("bad") / at(lambda _, r: r.bad)) / (F.col("bad") / at(lambda _, r: r.bad) + F.col("good") / at(lambda _, r: r.good))
    likely = stems.where((rate >= PRECISION) & ((F.col("family") >= FAMILY) | (F.col("bad") >= COMMON * at(lambda k, _: docs[k]))))
    found: dict[str, dict[str, int]] = {}
    for r in likely.collect():
        n = known[r.lang]
        null = TIMES * n.bad / (TIMES * n.bad + n.good)
        if at_least(r.bad, r.bad + r.good, null) <= ALPHA / tried[r.lang]:
            found.setdefault(r.lang, {})[r.stem] = r.bad
    out = {}
    for lang, bad in sorted(found.items()):
        first = [s for s in bad if not any(s[:k] in bad for k in range(STEM[0], len(s)))]
        # the longest extension that nearly all of the stem's toxic words share
        out[lang] = sorted(max((t for t in bad if t.startswith(s) and bad[t] >= 0.98 * bad[s]), key=len) for s in first)
    return out


def fitted_stems(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Stems:
    """Stems from at most `sample` labelled documents of either kind and each
    language, drawn by hash. The draw is a list of ids of bounded size, so it is
    broadcast. A null language is the language ""."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spoken = docs.where("text is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    order = Window.partitionBy("lang", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = spoken.join(known, "doc_id").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= sample).select("doc_id", "toxic").distinct()
    return stems_from(docs.where("text is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").join(F.broadcast(drawn), "doc_id").select("lang", "text", "toxic"))


def toxicity(docs: DataFrame, stems: Stems | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, clauses, is_toxic) of every row of docs; doc_id as given.

    Null, empty and blank texts score 0 and are not toxic. Very long texts are
    scored whole, their bare words by density. Equal texts of one language
    score alike; ties don't arise, repeated rows and null ids are scored like
    any other. A null language is the language "". Extra columns are ignored,
    whatever their names; an empty table gives an empty table.
    """
    stems = stems or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        every = sorted({s for some in stems.values() for s in some})
        by = {lang: (*lexicon(some), tuple(some)) for lang, some in {**{"": []}, **stems}.items()}
        plain = (*lexicon([]), ())
        coarse = sieve(every)
        for batch in batches:
            text = batch.column(1)
            at = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(text, coarse), False), bool))
            score, clauses = np.zeros(len(text)), np.zeros(len(text), np.int32)
            pick = pa.array(at)
            for i, t, lang in zip(at.tolist(), text.take(pick).to_pylist(), batch.column(2).take(pick).to_pylist()):
                words, pattern, own = by.get(lang, plain)
                if pattern.search(t):
                    score[i], clauses[i] = score_text(t, machine, words, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(clauses), pa.array(score >= threshold)], ["doc_id", "score", "clauses", "is_toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(run, f"doc_id {kind}, score double, clauses int, is_toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return toxicity(docs, fitted_stems(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
