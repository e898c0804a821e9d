"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned: words and word beginnings (stems) whose document frequency among toxic documents of a bounded
training sample is far above that among others, besides a few general insults. Its trie is intersected with the
Levenshtein automata of all its words at once: a state is the set of (trie node, errors so far), made when first
reached and then kept, so running a word costs a table look-up for each character and most words die after a few.
A whole word of FUZZY_FROM characters or more is found with one error (two from FUZZY_TWO_FROM on); a stem exactly.

Each hit is weighed by its term and distance and by a window of words around it: hits in quotation marks or near a
reporting word count as quotation, others as abuse, more so beside a word of address. A logistic model of these sums
gives the score.

Defined results: a null or blank text has no hits and gets the model's score for none; repeated rows are scored each
by itself; an empty table gives an empty result; without labels of both classes the model's fixed start values score;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, worker_cache

# General insults of the start lexicon, words of reporting and of address.
INSULTS = ("asshole", "bastard", "clown", "coward", "creep", "degenerate", "disgusting", "dumbass", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "loser", "lunatic", "moron", "pathetic", "pervert", "retard", "scum", "scumbag", "stupid", "trash", "vermin", "weirdo", "worthless")
REPORTING = frozenset(("said", "says", "called", "calling", "quote", "quoted", "quoting", "word", "words", "term", "wrote", "writes", "insult", "insults", "according", "dijo", "palabra", "sagte", "wort", "mot", "dit"))
ADDRESS = frozenset(("you", "your", "you're", "youre", "u", "du", "dein", "ihr", "sie", "tu", "toi", "vous", "usted", "eres", "bist", "es"))
QUOTES = "\"“”„«»‘‚"
STRIP = "\"“”„«»‘’‚'.,;:!?()[]{}<>|#*$%&-_=+/\\~`…¡¿"
#: Words on either side of a hit that decide about it.
WINDOW = 6
FUZZY_FROM, FUZZY_TWO_FROM = 5, 11
#: Bound of the training sample: documents of each class. It bounds the lexicon too.
MAX_FIT = 2000
STEM_LENGTHS = range(4, 9)
#: Least lift, and least log-likelihood ratio: as some millions of candidates are tried, chance alone comes near 22 now and then.
MIN_LIFT, MIN_RATIO = 5.0, 22.0
MAX_KEPT = 200_000
N_FEATURES = 6
START_MODEL = (-3.0, 2.5, 1.0, 0.0, 0.4, -0.5, 0.0)


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any ending may follow
    weight: float


class LexiconAutomaton:
    """The Levenshtein automata of all whole words, run over the trie of the lexicon; made deterministic as it is used."""

    def __init__(self, terms: Iterable[Term]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[Term]] = [[]]
        #: Errors allowed to the words below a node, at most; stems allow none.
        self.slack: list[int] = [0]
        for term in terms:
            k = 0 if term.stem or len(term.text) < FUZZY_FROM else 1 if len(term.text) < FUZZY_TWO_FROM else 2
            node = 0
            self.slack[0] = max(self.slack[0], k)
            for c in term.text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.slack.append(0)
                node = self.next[node][c]
                self.slack[node] = max(self.slack[node], k)
            self.ends[node].append(term)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.intern({0: 0})

    def allowed(self, term: Term) -> int:
        return 0 if term.stem or len(term.text) < FUZZY_FROM else 1 if len(term.text) < FUZZY_TWO_FROM else 2

    def intern(self, best: dict[int, int]) -> int:
        """The state of the least errors at each node, closed under skipped trie characters; -1 if empty."""
        queue = list(best.items())
        while queue:
            node, e = queue.pop()
            for child in self.next[node].values():
                if e + 1 <= self.slack[child] and e + 1 < best.get(child, 99):
                    best[child] = e + 1
                    queue.append((child, e + 1))
        key = frozenset(best.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, e in self.sets[state]:
            child = self.next[node].get(c)
            if child is not None and e < best.get(child, 99):
                best[child] = e
            if e + 1 <= self.slack[node] and e + 1 < best.get(node, 99):
                best[node] = e + 1  # a character too many
            for other in self.next[node].values():
                if other != child and e + 1 <= self.slack[other] and e + 1 < best.get(other, 99):
                    best[other] = e + 1  # a wrong character
        found = self.moves[state][c] = self.intern(best)
        return found

    def find(self, word: str) -> tuple[float, int] | None:
        """(strength, distance) of the best term for a word: its weight, less for each error."""
        state, best = self.start, None
        for c in word:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return best
            for node, e in self.sets[state] if self.has_stem(state) else ():
                for t in self.ends[node]:
                    if t.stem and e == 0:
                        best = max(best or (0.0, 0), (t.weight, 0))
        for node, e in self.sets[state]:
            for t in self.ends[node]:
                if e <= self.allowed(t):
                    got = (t.weight * 0.85**e, e)
                    best = got if best is None or got[0] > best[0] else best
        return best

    def has_stem(self, state: int) -> bool:
        found = self.moves[state].get("")
        if found is None:
            found = self.moves[state][""] = int(any(t.stem and e == 0 for node, e in self.sets[state] for t in self.ends[node]))
        return bool(found)


class Finder:
    """Hits of texts; what is known of words stays in a table of bounded size."""

    def __init__(self, terms: list[Term]):
        self.automaton = LexiconAutomaton(terms)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        distinct = set(tokens)
        new = (distinct - self.clean).difference(self.hits)
        if len(self.clean) + len(new) > MAX_KEPT:
            self.clean.clear()
            self.hits.clear()
            new = distinct
        for token in new:
            word = token.strip(STRIP)
            found = self.automaton.find(word) if len(word) >= 3 else None
            if found:
                self.hits[token] = found
            else:
                self.clean.add(token)
        if distinct.isdisjoint(self.hits):
            return [0.0] * N_FEATURES
        abuse = quoted = 0.0
        strongest, n, kinds, inside = 0.0, 0, set(), quotation(tokens)
        for i, token in enumerate(tokens):
            hit = self.hits.get(token)
            if hit is None:
                continue
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            words = {w.strip(STRIP) for w in near}
            n += 1
            kinds.add(token.strip(STRIP))
            if i in inside or not words.isdisjoint(REPORTING):
                quoted += hit[0]
            else:
                abuse += hit[0] * (1.0 if words.isdisjoint(ADDRESS) else 1.3)
                strongest = max(strongest, hit[0])
        return [math.log1p(abuse), strongest, math.log1p(quoted), math.log1p(len(kinds)), math.log(n / len(tokens) + 1e-4) + 6.0, float(n > 1)]


def quotation(tokens: list[str]) -> set[int]:
    """Places of words between an opening and a closing quotation mark at most 2 * WINDOW words apart."""
    marks = [(i, t[:1] in QUOTES, t.rstrip(".,;:!?")[-1:] in QUOTES) for i, t in enumerate(tokens) if any(q in t for q in QUOTES)]
    inside: set[int] = set()
    opened = None
    for i, opens, closes in marks:
        if opens:
            opened = i
        if closes and opened is not None and i - opened <= 2 * WINDOW:
            inside.update(range(opened, i + 1))
            opened = None
    return inside


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]  # the bias first

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ np.array(self.weights[1:])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def start_terms() -> list[Term]:
    return [Term(w, False, 2.0) for w in INSULTS]


def term_column(text: Column) -> Column:
    """Distinct words (ending in a blank) and stems of a text."""
    words = F.array_distinct(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")))
    words = F.filter(words, lambda w: F.length(w).between(3, 40))
    stems = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.concat(w, F.lit(" "))), F.transform(F.filter(F.array(*[F.lit(n) for n in STEM_LENGTHS]), lambda n: n < F.length(w)), lambda n: F.substring(w, F.lit(1), n)))))
    return F.array_distinct(stems)


def choose_terms(rows: list, positives: int, negatives: int) -> list[Term]:
    """Terms by lift and support; a term that a chosen stem covers, or that covers a chosen term, is left out.

    Whole words that can be found with errors stay beside the stem that covers them, as a stem is found exactly only.
    """
    rated = []
    for r in rows:
        lift = ((r["pos"] + 0.5) / (positives + 1)) / ((r["neg"] + 0.5) / (negatives + 1))
        if lift >= MIN_LIFT:
            rated.append((math.log(lift) * math.sqrt(r["pos"]), r["term"], math.log(lift)))
    chosen: dict[str, Term] = {}
    beside: list[Term] = []
    beginnings: set[str] = set()
    # Of equals the whole word is taken, as it can be found with errors, then the longer stem.
    for _, term, weight in sorted(rated, key=lambda x: (-round(x[0], 6), not x[1].endswith(" "), -len(x[1]), x[1])):
        text, stem = term.strip(), not term.endswith(" ")
        if any(text[:n] in chosen and (chosen[text[:n]].stem or n == len(text)) for n in range(3, len(text) + 1)):
            if not stem and len(text) >= FUZZY_FROM:
                beside.append(Term(text, False, min(weight, 6.0)))
            continue
        if stem and text in beginnings:
            continue
        chosen[text] = Term(text, stem, min(weight, 6.0))
        beginnings.update(text[:n] for n in range(3, len(text) + 1))
    return [*chosen.values(), *beside]


def with_start_terms(learned: list[Term]) -> tuple[Term, ...]:
    """Learned terms, and the general insults that are not among them as whole words."""
    known = {t.text for t in learned if not t.stem}
    return tuple(learned + [t for t in start_terms() if t.text not in known])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a ridge; the bias is not shrunk."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(a.shape[1]), np.diag([1e-9] + [ridge] * x.shape[1])
    weight = weight / weight.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - shrink @ w
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + shrink
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return w


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learnable: Column | None = None) -> Model:
    """Learn lexicon and weights from MAX_FIT labelled documents of each class, chosen by a hash of their ids.

    One half of them, dealt by that hash, gives the terms, the other the weights, so the weights are not fitted to
    chance terms. ``learnable``: which rows of labels may be learned from.
    """
    keyed = labels.filter(learnable) if learnable is not None else labels
    keyed = keyed.select(F.col(id_col).alias("fit_id"), F.col(label_col).cast("int").alias("fit_label")).filter("fit_id is not null and fit_label in (0, 1)")
    totals = {r["fit_label"]: r["count"] for r in keyed.groupBy("fit_label").count().collect()}
    chosen = [keyed.filter(F.col("fit_label") == y).orderBy(F.xxhash64("fit_id"), "fit_id").limit(MAX_FIT) for y in (0, 1)]
    wanted = F.broadcast(chosen[0].union(chosen[1]))  # MAX_FIT rows of each class at most
    texts = docs.select(F.col(id_col).alias("fit_id"), F.col(text_col).alias("text")).filter("text <> ''")
    texts = texts.join(wanted, "fit_id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    # Copies of a text count once.
    texts = texts.groupBy(F.xxhash64("text").alias("copy"), "half", "fit_label").agg(F.first("text").alias("text")).persist()
    try:
        sizes = {(r["half"], r["fit_label"]): r["count"] for r in texts.groupBy("half", "fit_label").count().collect()}
        if any(sizes.get((h, y), 0) == 0 for h in (0, 1) for y in (0, 1)):
            return Model(tuple(start_terms()), START_MODEL)
        terms = texts.filter("half = 0").select("fit_label", F.explode(term_column(F.col("text"))).alias("term"))
        counts = terms.groupBy("term").agg(F.sum("fit_label").alias("pos"), F.count_if(F.col("fit_label") == 0).alias("neg"))
        lift = ((F.col("pos") + 0.5) / (sizes[0, 1] + 1)) / ((F.col("neg") + 0.5) / (sizes[0, 0] + 1))
        # Terms of a bounded sample that pass both tests: few reach the driver.
        share = sizes[0, 1] / (sizes[0, 1] + sizes[0, 0])
        part = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("pos") + F.col("neg")) * p))).otherwise(0.0)
        ratio = 2 * (part("pos", share) + part("neg", 1 - share))
        best = counts.filter((ratio >= MIN_RATIO) & (lift >= MIN_LIFT)).collect()
        learned = choose_terms(best, sizes[0, 1], sizes[0, 0])
        terms_all = with_start_terms(learned)
        rows = features_of(texts.filter("half = 1"), terms_all, ["fit_label"]).collect()
    finally:
        texts.unpersist()
    rows.sort(key=lambda r: (r["fit_label"], r["features"]))
    y = np.array([r["fit_label"] for r in rows], float)
    x = np.array([r["features"] for r in rows])
    each = {c: totals[c] / max(1, int((y == c).sum())) for c in (0, 1)}
    return Model(terms_all, tuple(logistic(x, y, np.where(y == 1, each[1], each[0]), 1e-3 + 0.1 / len(y)).tolist()))


def finder(terms: tuple[Term, ...]) -> Finder:
    kept = worker_cache("toxicity")
    if terms not in kept:
        kept.clear()
        kept[terms] = Finder(list(terms))
    return kept[terms]


def features_of(docs: DataFrame, terms: tuple[Term, ...], keep: list[str], text_col: str = "text") -> DataFrame:
    base = docs.select(*keep, F.col(text_col).alias("text"))
    shown = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(terms)
        for b in batches:
            rows = [find.features(t.as_py() or "") for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    return map_texts(base, run, f"{shown}, features array<double>")


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, abuse, quoted): the score, and the window sums (log1p) of abuse and of quotation."""
    found = features_of(docs, model.terms, [id_col], text_col)
    z = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        z = z + F.col("features")[i] * F.lit(w)
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return found.select(id_col, score.alias("score"), F.col("features")[0].alias("abuse"), F.col("features")[2].alias("quoted")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose score is 0.5 or more; all columns stay, and nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(model.terms)
        for b in batches:
            features = np.array([find.features(t.as_py() or "") for t in b.column(at)]).reshape(b.num_rows, N_FEATURES)
            yield b.filter(pa.array(model.score(features) < 0.5, pa.bool_()))

    return map_texts(docs, run, docs.schema)
