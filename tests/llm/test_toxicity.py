import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pointloom.llm.toxicity import CLASSES, GAP, LIGHT, SPARSE, THRESHOLD, WEIGHTS, at_least, fitted_stems, grammar, lexicon, score_text, sieve, toxicity

from .helpers import ODD, clashing, frame, words

PERSONS = {"second": "2", "joined second": "2", "third": "3", "joined third": "3"}


def score(text, stems=()):
    table, _ = lexicon(list(stems))
    return score_text(text, grammar(), table, tuple(stems))


def brute(symbols, quoted=False):
    """(directed score, weights of bare insults) of a clause, word by word and
    by looking around: no states."""
    kind = lambda i: symbols[i]
    consuming = lambda i: kind(i) not in (*LIGHT, "negation", "quote")

    def negated(i):
        return any(kind(j) == "negation" and sum(kind(k) not in LIGHT for k in range(j + 1, i)) < GAP for j in range(i))

    def inside(i):
        return (quoted + sum(kind(k) == "quote" for k in range(i))) % 2 == 1

    def told(i):
        said = [j for j in range(i) if kind(j) == "report"]
        return inside(i) or any(not any(kind(k) == "quote" and inside(k) for k in range(j, i)) for j in said)

    def marks(i):
        out = ""
        for j in range(i - 1, -1, -1):
            if kind(j) in ("insult", "mild"):
                break
            if kind(j) in PERSONS:
                # a copula counts if it comes while the person is still in reach
                base, linked = j, kind(j).startswith("joined")
                for k in range(j + 1, i):
                    if kind(k) == "copula" and sum(map(consuming, range(base + 1, k))) < GAP:
                        base, linked = k, True
                gap = sum(map(consuming, range(base + 1, i)))
                if (linked and gap < GAP) or (PERSONS[kind(j)] == "2" and gap == 0):
                    out += PERSONS[kind(j)]
                break
        for j in range(i - 1, -1, -1):
            if kind(j) in ("insult", "mild") or kind(j) in PERSONS:
                break
            if kind(j) == "intensifier":
                out += "i" if sum(map(consuming, range(j + 1, i))) < GAP else ""
                break
        return out

    total, bare = 0.0, []
    for i, s in enumerate(symbols):
        if s not in ("insult", "mild"):
            continue
        m = marks(i)
        if negated(i):
            continue
        w = WEIGHTS[s] + ("2" in m) * WEIGHTS["second"] + ("3" in m) * WEIGHTS["third"] + ("i" in m) * WEIGHTS["intense"] + told(i) * WEIGHTS["reported"]
        if w <= 0:
            continue
        if m:
            total += w
        else:
            bare.append(w)
        if "2" not in m and "3" not in m and i + 1 < len(symbols) and PERSONS.get(kind(i + 1)) == "2":
            total += WEIGHTS["second"]
    ended = -1
    light = lambda a, b: sum(kind(k) not in LIGHT for k in range(a + 1, b))
    for i, s in enumerate(symbols):
        if s not in ("threat", "fight"):
            continue
        # intent is spent where a threat ended after it
        meant = any(kind(j) == "intent" and j > ended and light(j, i) < GAP for j in range(i))
        if negated(i) or (s == "fight" and not meant):
            continue
        worth = max(0.0, WEIGHTS["threat"] + told(i) * WEIGHTS["reported"])
        floor = max((k for k in range(i) if kind(k) in ("threat", "fight")), default=-1)
        if any(kind(j) == "object" and j > max(floor, ended) and light(j, i) < GAP for j in range(i)):
            total += worth
            continue
        for j in range(i + 1, len(symbols)):
            if kind(j) in ("threat", "fight"):
                break
            if light(i, j) >= GAP:
                break
            if PERSONS.get(kind(j)) == "2" or kind(j) == "object" or (PERSONS.get(kind(j)) == "3" and s == "threat" and meant):
                total += worth
                ended = j
                break
    return total, bare


def machine_scores(symbols, quoted=False):
    total, bare = 0.0, []
    for (mark, w), s in zip(grammar()[quoted].run(symbols), symbols):
        if s in ("insult", "mild") and w > 0 and not set(mark.partition("/")[2]) & set("23i"):
            bare.append(w)
        else:
            total += w
    return total, bare


@pytest.mark.parametrize("pool", [CLASSES, ["insult", "mild", "second", "third", "copula", "intensifier", "negation", "quote", "report", "other"], ["threat", "fight", "second", "third", "object", "intent", "negation", "report", "other", "article"]])
def test_like_a_scorer_without_states(pool):
    rng = random.Random(3)
    for _ in range(3000):
        symbols = [rng.choice(pool) for _ in range(rng.randrange(1, 11))]
        quoted = rng.random() < 0.2
        (a, x), (b, y) = machine_scores(symbols, quoted), brute(symbols, quoted)
        assert abs(a - b) < 1e-9 and [round(v, 9) for v in x] == [round(v, 9) for v in y], (symbols, quoted, a, b, x, y)


def test_patterns():
    for text in ("you are an idiot", "you idiot.", "what an idiot", "he is a moron", "idiot you", "i will kill you", "we will kill them", "i'll burn you", "you clown", "they're vermin, and so are you morons", 'he said "hello" and you are a moron'):
        assert score(text)[0] >= THRESHOLD, text
    for text in ("you are not an idiot", "the report said idiot", "i will not kill you", "how to kill a process", "a clear day", "idiot", "i see you kill a process", "she said you are an idiot"):
        assert score(text)[0] < THRESHOLD, text


@pytest.mark.parametrize("text", ["a degenerate triangle", "take out the trash", "the clown fish", "burn these files", "beat them 3-1", "they hunt and people eat", "she said hello and you are an idiot", "he is a clown", 'the sign read "idiot"', '"quiet. you idiot"'])
def test_no_isolated_word_or_report_is_toxic(text):
    assert score(text)[0] < THRESHOLD


def test_bare_words_add_up_by_density():
    assert score("idiot. moron.")[0] >= THRESHOLD and score("idiot. moron. scum.")[1] == 3
    filler = "nothing to see. " * (5 * SPARSE)
    assert score("idiot. " + filler + "moron.")[0] < THRESHOLD
    assert score("idiot moron. " + "nothing to see. " * (SPARSE // 3))[0] >= THRESHOLD
    assert score(filler + "you are an idiot")[0] >= THRESHOLD


def test_sieve_lets_every_hit_through():
    stems = ["grobl", "éta", "íie"]
    _, pattern = lexicon(stems)
    texts = ["an idiot", "IDIOT", "x.Moron!", "Grobling", "a éTAnt", "Étalon", "ÍIEs", "\nscum", "é idiots", "1 trash", "_loser", "ñidiot", "groblé", "lésions", "", "plain"]
    hit = pc.match_substring_regex(pa.array(texts), sieve(stems)).to_pylist()
    assert all(h for t, h in zip(texts, hit) if pattern.search(t))
    assert not hit[-1] and sum(map(bool, map(pattern.search, texts))) >= 9


def test_binomial_tail():
    from math import comb

    for b, n, p in ((0, 5, 0.3), (3, 7, 0.2), (7, 7, 0.4)):
        assert abs(at_least(b, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(b, n + 1))) < 1e-12


def labelled(n=1200, seed=2):
    """A tenth toxic: German ones by words of one family, English by a seed."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w, toxic = words(rng, rng.randrange(20, 80)), i % 10 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), f"grobl{rng.choice(['en', 'ig', 'isch', 'on'])}" if i % 20 else "moron")
        rows.append((i, " ".join(w), "de" if i % 20 else "en"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_stems_are_found_and_generalise(spark):
    rows, labels = labelled()
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    stems = fitted_stems(docs, lab.where("doc_id < 800"))
    assert list(stems) == ["de"] and all(s.startswith("grobl") for s in stems["de"])
    got = {r.doc_id: r.is_toxic for r in toxicity(docs, stems).collect()}
    held = [(got[i], t) for i, _, t in labels if i >= 800]
    assert sum(g for g, t in held if t) / sum(t for _, t in held) >= 0.9
    assert sum(g for g, t in held if not t) / sum(not t for _, t in held) <= 0.01
    few = fitted_stems(docs, lab.where("doc_id < 120"))
    assert few == {} or all(s.startswith("grobl") for s in few["de"])


def test_copies_of_one_toxic_document_make_no_stem(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40))) for i in range(300)] + [(1000 + i, rows_ + f" x{i}") for i in range(6) for rows_ in ["zorp quall brindle " + " ".join(words(random.Random(9), 40))]]
    labels = [(i, 1, int(i >= 1000)) for i, _ in rows]
    stems = fitted_stems(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").where("doc_id < 1003 or doc_id < 300"))
    got = toxicity(frame(spark, rows), stems).where("is_toxic and doc_id < 1000").count()
    assert got == 0


def test_odd_rows(spark):
    docs = frame(spark, ODD + [(30, "you MORON!"), (30, "you MORON!"), (None, "you morons", None), (31, "word. " * 60_000 + "you are an idiot")])
    rows = toxicity(docs).collect()
    assert len(rows) == len(ODD) + 4
    assert sum(r.is_toxic for r in rows) == 4
    assert toxicity(clashing(docs)).count() == len(rows)
    assert toxicity(docs.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fitted_stems(docs, none) == {}
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text", "lang")
    assert {r.doc_id for r in toxicity(named).where("is_toxic").collect()} == {"d30", "d31", None}


def test_seeds_and_threats_of_other_languages():
    table, pattern = lexicon([])
    toxic = ["du bist ein trottel", "quel connard", "eres un gilipollas", "ich werde dich töten", "je vais te tuer", "je vais t'étrangler", "voy a matarte", "te mataré", "TE MATARÉ"]
    for text in toxic:
        assert pattern.search(text) and score_text(text, grammar(), table, ())[0] >= THRESHOLD, text
    assert all(pc.match_substring_regex(pa.array(toxic), sieve([])).to_pylist())
    for text in ("tuer le temps", "nicht dich töten", "matar el proceso", "te dejo la matarteria", "dich mag ich"):
        assert score(text)[0] < THRESHOLD, text
