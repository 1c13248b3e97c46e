"""Toxicity by a weighted finite-state pattern grammar.

An automaton over all terms finds where a text may be toxic; only clauses around such places are read. A clause becomes
a string of classes (insult, threat, target, negation, report, other), which runs through one transducer composed of
three: negation marks the hits it governs, reported speech (verbs of saying, quotation marks) marks what it reports,
and target marks hits after somebody addressed, or somebody addressed after a hit. Each clause adds up its terms' weights
per kind of match; a document's score is the logistic of a weighted sum over its clauses, a repeated one counting once,
less a weight per word: two hits in ten words say more than two in ten thousand.

Learned from labels, besides the seed lexicon:
- terms (words, or word beginnings) that are far more frequent in toxic texts, weighted by the logarithm of how much
  more; of overlapping candidates the one that tells the classes apart best stays;
- which of them are threats: those that stand before somebody addressed ("hurt you") far oftener than after;
- further targets: words that stand beside insults and threats far oftener than elsewhere in toxic texts;
- how many words a negation reaches, the weights of the kinds of matches and where the cut of 0.7 falls, from each half
  of the sample under the terms learned from the other half, as a text always holds terms that were learned from it.
All of it is fitted on at most TOXIC and CLEAN labelled rows, the first in the order of a hash of doc_id, of those with
crc32(doc_id as text) mod 3 other than 1; of near copies (grouped()) one a class counts, so that a
much-copied text does not make all its words toxic. The terms are as many as that sample bears out, without a cap.
labels, lang, source and doc_id are no inputs of a score.

Defined results: null, empty and very long texts are scored like all others (a text without a hit scores at most what an
empty one does); rows of null doc_id are scored and never learned from, and are not held out; without labels of both
classes the built-in weights hold; repeated rows score alike; an empty table gives an empty result. Other columns are
carried by judged() unless they are named score or predicted.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, written
from .components import components

TOXIC, CLEAN = 2000, 4000
#: A term is learned when at least so many texts have it and it is so many times as frequent in toxic texts.
MIN_TEXTS, MIN_ODDS = 4, 10.0
#: Lengths of word beginnings; reaches of a negation.
BEGINS, REACHES = (4, 5, 6, 7, 8), (1, 3, 5)
CUT = 0.7
#: Near copies in the sample: the similarity of their word sets, and bands of so many registers that look for them.
SIMILAR, BANDS, ROWS = 0.8, 10, 3

# The seed lexicon, in four languages.
INSULTS = """idiot idiots stupid moron morons loser losers pathetic worthless scum trash disgusting clown dumb imbecile cretin vermin filth bastard asshole fool jerk pig
idiota imbécil estúpido estúpida basura escoria inútil asqueroso payaso idiote imbécile stupide minable ordure déchet dégoûtant crétin dummkopf trottel abschaum widerlich wertlos dreckig müll""".split()
THREATS = """kill murder hurt destroy burn hang shoot stab beat strangle matar matarte destruir quemar golpear tuer tuerai détruire brûler frapper töten umbringen zerstören verbrennen erschießen""".split()
TARGETS = frozenset("""you your yours yourself u ur he she they him her them these those everyone tú te tu ti usted ustedes vosotros ellos él ella vous toi votre vos ils elles lui du dich dir dein ihr euch sie er""".split())
NEGATIONS = frozenset("""not no never neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot nunca jamás sin tampoco ne pas jamais sans aucun nicht kein keine nie niemals ohne""".split())
REPORTS = frozenset("""said says say saying wrote writes claimed claims quoted quote quotes reported reports called calls according dijo dice escribió según afirmó dit disait écrit selon affirme sagte sagt schrieb laut behauptet""".split())
QUOTES = frozenset('"“”„«»')
#: Kinds of matches and hundreds of words, their weights before anything is learned, and the constant.
KINDS = ("insult", "targeted insult", "negated", "reported", "threat", "targeted threat")
PRIOR = np.array([0.8, 1.1, 0.1, 0.25, 0.5, 1.2, -0.3, -2.5])
SEED_WEIGHT = 2.5
_CLAUSE = re.compile(r"[.!?;:\n]+|,(?=\s)")
_EDGES = " .!?;:,\n\t"
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]")


class Transducer:
    """Deterministic: arcs map (state, symbol) to (state, output); a symbol without an arc passes unchanged and keeps the state."""

    def __init__(self, arcs: dict[tuple[object, str], tuple[object, str]], start: object = 0):
        self.arcs, self.start = arcs, start

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, s = self.step(state, s)
            out.append(s)
        return out


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The transducer that does what first, then second do, over the reachable pairs of their states."""
    arcs, todo, seen = {}, [(first.start, second.start)], set()
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        for symbol in alphabet:
            a, middle = first.step(state[0], symbol)
            b, out = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out)
            todo.append((a, b))
    return Transducer(arcs, (first.start, second.start))


# Input classes: I insult, T threat, Y target, N negation, R report, Q quotation mark, O other. Marks on hits: - negated, " reported, + targeted.
ALPHABET = ["I", "T", "Y", "N", "R", "Q", "O"]


@cache
def grammar(reach: int = 3) -> Transducer:
    """The composed transducer; a negation governs the next hit within so many words."""
    far = range(1, reach + 1)
    negation = Transducer({(k, "N"): (reach, "N") for k in range(reach + 1)} | {(k, s): (k - 1, s) for k in far for s in "OY"} | {(k, s): (0, s + "-") for k in far for s in "IT"})
    # a report governs the rest of the clause, a quotation mark up to the next one
    report = Transducer({(0, "R"): ("said", "R"), (0, "Q"): ("quoted", "Q"), ("quoted", "Q"): (0, "Q")} | {(k, s): (k, s + '"') for k in ("said", "quoted") for s in ("I", "T", "I-", "T-")})
    # somebody addressed before a hit, or after one (a late +)
    target = Transducer({(0, "Y"): ("y", "Y"), ("hit", "Y"): ("y", "+")} | {(0, s): ("hit", s) for s in ("I", "T")} | {("y", s): ("y", s + "+") for s in ("I", "T")})
    return compose(compose(negation, report, ALPHABET), target, ALPHABET)


_KIND = {"I": 0, "I+": 1, "T": 4, "T+": 5}


def kind_of(symbol: str) -> int | None:
    return 3 if symbol.endswith('"') else 2 if symbol.endswith("-") else _KIND.get(symbol)


class Grammar:
    """terms: (term, class I or T, weight); a term ending in * is a word beginning."""

    def __init__(self, terms: list[tuple[str, str, float]], targets: frozenset[str] = TARGETS, reach: int = 3):
        self.automaton, self.targets, self.transducer = ahocorasick.Automaton(), targets, grammar(reach)
        exact: dict[str, dict[bool, tuple[str, float]]] = {}
        for term, kind, weight in terms:
            exact.setdefault(term.rstrip("*"), {})[term.endswith("*")] = (kind, weight)
        for text, forms in exact.items():
            self.automaton.add_word(text, (len(text), forms))
        self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[str, float]]:
        """Class and weight of the weightiest term that begins at a place of the lower-cased text."""
        out: dict[int, tuple[str, float]] = {}
        for end, (size, forms) in self.automaton.iter(text):
            at = end - size + 1
            if at and text[at - 1].isalnum():
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalnum()
            found = (forms.get(False) if whole else None) or forms.get(True)
            if found and (at not in out or found[1] > out[at][1]):
                out[at] = found
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Per kind, the matches' weights summed over the distinct clauses; then the words, in hundreds."""
        out = np.zeros(len(KINDS) + 1)
        if not text:
            return out
        text = text.lower()
        out[-1] = len(text.split()) / 100
        if not (hits := self.hits(text)):
            return out
        ends, places = [m.start() for m in _CLAUSE.finditer(text)], sorted(hits)
        seen = set()
        for k in sorted({bisect.bisect_left(ends, at) for at in hits}):
            at, to = ends[k - 1] if k else 0, ends[k] if k < len(ends) else len(text)
            if (clause := text[at:to].strip(_EDGES)) not in seen:
                seen.add(clause)
                out[:-1] += self._clause(text, at, to, hits, places)
        return out

    def symbols(self, text: str, at: int, to: int, hits: dict[int, tuple[str, float]], places: list[int]) -> list[tuple[str, float, str]]:
        """(class, weight, word) of a clause's tokens."""
        out = []
        for m in _TOKEN.finditer(text, at, to):
            inside = places[bisect.bisect_left(places, m.start()) : bisect.bisect_left(places, m.end())]
            # what stands before a hit's apostrophe counts only if it has a class of its own: the l of l'idiote is no word
            word = text[m.start() : inside[0] - 1 if inside and inside[0] > m.start() else m.end()].replace("’", "'")
            if not inside or inside[0] > m.start():
                symbol = "Q" if word in QUOTES else "N" if word in NEGATIONS else "R" if word in REPORTS else "Y" if word in self.targets else "O"
                if symbol != "O" or not inside:
                    out.append((symbol, 0.0, word))
            out += [(*hits[place], "") for place in inside]
        return out

    def _clause(self, text: str, at: int, to: int, hits: dict[int, tuple[str, float]], places: list[int]) -> np.ndarray:
        tokens = self.symbols(text, at, to, hits, places)
        out, last = np.zeros(len(KINDS)), None
        for symbol, (_, weight, _) in zip(self.transducer.run([t[0] for t in tokens]), tokens, strict=True):
            kind = kind_of(symbol)
            if symbol == "+" and last is not None:  # the hit before it was aimed at somebody
                kind, weight = last[0] + 1, last[1]
                out[last[0]] -= weight
                last = None
            if kind is not None:
                out[kind] += weight
                last = (kind, weight) if kind in (0, 4) else last
        return out


def seed_terms() -> list[tuple[str, str, float]]:
    return [(t, "I", SEED_WEIGHT) for t in INSULTS] + [(t, "T", SEED_WEIGHT) for t in THREATS]


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression (the last a constant) by Newton steps, pulled to the prior, and its loss.

    No kind of match may speak against toxicity, and no length for it.
    """
    x, w = np.hstack([x, np.ones((len(x), 1))]), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - y)) + pull * (w - prior)
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        w[: len(KINDS)] = np.maximum(w[: len(KINDS)], 0.0)
        w[len(KINDS)] = min(w[len(KINDS)], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(weights * np.where(y > 0, np.log(p), np.log(1 - p))).sum())


def at_cut(z: np.ndarray, y: np.ndarray, weights: np.ndarray, cut: float = CUT) -> float:
    """What to add to the logits so that the cut falls where it finds the best balance of precision and recall (F1)."""
    order = np.argsort(-z, kind="stable")
    z, hit, all_ = z[order], np.cumsum((weights * y)[order]), np.cumsum(weights[order])
    f1 = 2 * hit / (all_ + hit[-1])
    last = np.append(z[1:] != z[:-1], True)  # a cut lies between different values
    best = int(np.argmax(np.where(last, f1, -1.0)))
    below = z[best + 1] if best + 1 < len(z) else z[best] - 1.0
    return float(np.log(cut / (1 - cut)) - (z[best] + below) / 2)


def _words(text: Column) -> Column:
    """The text's distinct words of at least three letters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 3))


def grouped(sample: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Adds group, a long that near copies in the sample share: texts linked by word sets of a similarity of `similar` or more.

    Equal sets are one class. A class's minhash registers go into bands; in each band the classes are compared with the
    least of them, on their full sets, and links are followed to the end. So no text shares its group with others unless one of
    them is a near copy of it. The sample is bounded, and so is all of this.
    """
    d = sample.withColumn("_w", F.array_sort(_words(F.col("text")))).withColumn("_id", F.xxhash64("_w"))
    classes = d.where(F.size("_w") > 0).groupBy("_id").agg(F.first("_w").alias("_w"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("_m", b * ROWS + 1, ROWS)))
    classes = written(classes.withColumn("_m", _registers(F.col("_w"))).select("_id", "_w", F.explode(bands).alias("band")), "bands")
    least = classes.groupBy("band").agg(F.min_by(F.struct(F.col("_id").alias("to"), F.col("_w").alias("u")), "_id").alias("m"))
    near = F.size(F.array_intersect("_w", "m.u")) >= similar * F.size(F.array_union("_w", "m.u"))
    links = classes.join(least, "band").where((F.col("_id") != F.col("m.to")) & near).select(F.col("_id").alias("a"), F.col("m.to").alias("b")).distinct()
    roots = components(links).select(F.col("node").alias("_id"), "root")
    return d.join(roots, "_id", "left").select(*sample.columns, F.coalesce("root", "_id").alias("group"))


def _registers(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda i: F.array_min(F.transform(words, lambda w: F.xxhash64(i, w))))


def learned_terms(sample: DataFrame, min_texts: int = MIN_TEXTS, min_odds: float = MIN_ODDS) -> list[tuple[str, float]]:
    """(term, weight) of the words and word beginnings of the sample (text, toxic) that are at least min_odds times as frequent in toxic texts.

    A text counts each of its words once, and for a beginning all words that have it.
    """
    sample = sample if "group" in sample.columns else grouped(sample)
    d = sample.select("toxic", F.col("group").alias("g"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    d = d.groupBy("toxic", "g").agg(F.min("w").alias("w"))  # one of near copies

    def begins(k: int) -> Column:  # a lambda of two arguments would get the index as its second one
        return F.transform(F.filter("w", lambda w: F.char_length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    size = {r.toxic: r.n for r in d.groupBy("toxic").agg(F.sum(F.size("w")).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return []
    texts = d.where("toxic = 1").count()
    each = d.select("toxic", "g", F.explode(F.concat("w", *[begins(k) for k in BEGINS])).alias("term")).groupBy("term", "toxic", "g").agg(F.count("*").alias("n"))
    n = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    c = each.groupBy("term").agg(n(1).alias("t"), n(0).alias("c"), F.sum("toxic").alias("texts"))
    odds = (F.col("t") + 0.5) / size[1] / ((F.col("c") + 0.5) / size[0])
    c = c.withColumn("odds", odds).where((F.col("texts") >= max(min_texts, texts // 100)) & (F.col("odds") >= min_odds))
    rows = c.withColumn("tells", F.col("t") * F.ln("odds")).orderBy(F.desc("tells"), F.col("term").endswith("*"), F.desc(F.length("term")), "term").collect()  # bounded by the sample's toxic words
    out: list[tuple[str, float]] = []
    stems, begun = set(), set()  # what is taken, and all beginnings of it
    for r in rows:
        stem = r["term"].rstrip("*")
        if stem in begun or any(stem[:k] in stems for k in range(1, len(stem) + 1)):
            continue
        out.append((r["term"], float(np.log(r["odds"]))))
        stems.add(stem)
        begun.update(stem[:k] for k in range(1, len(stem) + 1))
    return out


def neighbours(sample: DataFrame, terms: list[tuple[str, str, float]], lift: float = 3.0, least: int = 8) -> tuple[frozenset[str], frozenset[str]]:
    """From the toxic texts: the terms that are threats by where the addressed stand, and further targets."""
    weights = {t: w for t, _, w in terms}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Grammar([(t, "I", float(i + 1)) for i, t in enumerate(weights)])  # the weight tells which term it was
        names, seen = list(weights), Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                text = (text or "").lower()
                hits = words.hits(text)
                places = sorted(hits)
                ends = [0, *[m.start() for m in _CLAUSE.finditer(text)], len(text)]
                for at, to in zip(ends, ends[1:], strict=False):
                    tokens = words.symbols(text, at, to, hits, places)
                    for i, (symbol, weight, word) in enumerate(tokens):
                        if symbol == "I":
                            term = names[int(weight) - 1]
                            before, after = tokens[max(0, i - 2) : i], tokens[i + 1 : i + 3]
                            seen["after", term] += any(t[0] == "Y" for t in after)
                            seen["before", term] += any(t[0] == "Y" for t in before)
                            seen["", ""] += len(before) + len(after)
                            for t in (*before, *after):
                                seen["beside", t[2]] += t[0] == "O"
                        elif symbol == "O":
                            seen["word", word] += 1
                        seen["all", ""] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], ["what", "word", "n"])

    d = sample.where("toxic = 1").select("text").mapInArrow(count, "what string, word string, n long").groupBy("what", "word").agg(F.sum("n").alias("n"))
    seen = {(r.what, r.word): r.n for r in d.where("what not in ('word', 'beside') or n >= 8").collect()}  # bounded by the sample's toxic words
    threats = frozenset(t for t in weights if seen.get(("after", t), 0) >= max(least, 2 * seen.get(("before", t), 0)))
    share = seen.get(("", ""), 0) / max(1, seen.get(("all", ""), 0))
    more = frozenset(w for (what, w), n in seen.items() if what == "beside" and len(w) > 1 and n >= max(least, lift * share * seen.get(("word", w), 0)))
    return threats, more


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(0))


class Model:
    def __init__(self, terms: list[tuple[str, str, float]], weights: np.ndarray, targets: frozenset[str] = TARGETS, reach: int = 3):
        self.terms, self.weights, self.targets, self.reach = terms, weights, targets, reach

    def grammar(self) -> Grammar:
        return Grammar(self.terms, self.targets, self.reach)

    def scores(self, texts: list[str | None], grammar: Grammar) -> np.ndarray:
        x = np.stack([grammar.features(t) for t in texts]) if texts else np.zeros((0, len(KINDS) + 1))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); toxic and clean bound the rows that are learned from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = row_hash(["doc_id"], 10)
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(toxic).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(clean))
    # at most toxic + clean rows, so the broadcast has a proven bound
    sample = written(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic"), "sample")
    sample = written(grouped(sample).withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(2)).cast("int")), "folds")

    def learn(part: DataFrame) -> tuple[list[tuple[str, str, float]], frozenset[str]]:
        seeds = {t: (t, k, w) for t, k, w in seed_terms()}
        terms = seeds | {t: (t, seeds.get(t, ("", "I"))[1], w) for t, w in learned_terms(part)}
        threats, more = neighbours(part, list(terms.values()))
        return [(t, "T" if t in threats and t not in seeds else k, w) for t, k, w in terms.values()], TARGETS | more

    terms, targets = learn(sample)
    halves = [learn(sample.where(F.col("fold") != k)) for k in (0, 1)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [[Grammar(*half, reach) for reach in REACHES] for half in halves]
        for b in batches:
            x = [np.concatenate([g.features(t) for g in grammars[k]]).tolist() for t, k in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    found = sample.select("toxic", "text", "fold").mapInArrow(rows, "toxic int, x array<double>").toPandas()  # at most toxic + clean rows
    if found.toxic.nunique() < 2:
        return Model(terms, PRIOR, targets)
    share = {k: total[k] / (found.toxic == k).sum() for k in (0, 1)}
    scale = len(found) / sum(total.values())
    y, weights = found.toxic.to_numpy(float), scale * found.toxic.map(share).to_numpy()
    x = np.stack(found.x.to_numpy()).reshape(len(found), len(REACHES), -1)
    fits = {reach: logistic(x[:, i], y, weights) for i, reach in enumerate(REACHES)}
    reach = min(fits, key=lambda k: (round(fits[k][1], 6), k != 3))
    w = fits[reach][0]
    w[-1] += at_cut(x[:, REACHES.index(reach)] @ w[:-1] + w[-1], y, weights)
    return Model(terms, w, targets, reach)


def judged(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """docs with score and predicted: one narrow pass."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = model.grammar()
        for b in batches:
            s = model.scores(b.column(text).to_pylist(), grammar)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(s), pa.array((s >= cut).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(score, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels)
    out = judged(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
