"""Toxicity by a fuzzy lexicon and its context.

1. ``learn_lexicon``: terms (whole words, or stems written ``stem*``) whose
   document frequency among toxic rows is a multiple of that among clean rows.
   A stem counts only where it has clearly more toxic rows than any one word
   of it, and one of a chain of stems stays; a word stays unless a stem taken
   makes it needless.
2. ``Matcher``: the terms in a trie, intersected with Levenshtein automata
   (up to 1 edit from 5 letters on, 2 from 8 on, stems too).  The product
   is determinised lazily: a state is the set of (trie node, edits) reached,
   and most words leave the automaton after a few letters.
3. ``features``: each hit counts its term's weight, less per edit, times a
   factor from a window of words around it: quoted or reported speech is
   discounted, address of a person or a second hit nearby is not.
4. A logistic regression over the features gives the score.

Lexicon and regression are fitted on a bounded, documented sample of labelled
rows (``sample_rows`` per class, thinned by a hash of the id; classes are
weighted back).  Scoring reads every whole text once; the lexicon (at most
``max_terms``) and five coefficients go to the tasks with the function.

Edge cases: null or empty text has no hits and the score of a hitless empty
text; repeated labels of one document count as toxic if any is; null labels
are not learned from; without both classes among the labels every score is 0;
repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batch, remainder, written
from tidemark.session import scratch_scope

WORDS = re.compile(r"[^\W_]+")
QUOTES = '"“”„«»'
#: Words that report what others said, and words that address someone.
REPORTING = frozenset("said says saying wrote writes called calls quote quoted quotes word term alleged according "
                      "dit dijo sagte nannte schrieb".split())
ADDRESS = frozenset("you your yours youre u du dich dein ihr tu toi vous eres usted".split())


@dataclass(frozen=True)
class Params:
    """``lift``: least ratio of a term's rates; ``support``: least part of the
    toxic sample that holds it; ``adds``: least multiple of its best word's
    toxic rows that a stem has; ``word_part``: least part of a stem's toxic
    rows with which a word of it stays; ``window``: words on either side of a
    hit."""

    sample_rows: int = 4000
    lift: float = 6.0
    support: float = 0.004
    max_terms: int = 300
    stems: tuple[int, int] = (3, 8)
    adds: float = 1.25
    word_part: float = 0.25
    window: int = 6
    reported: float = 0.3
    addressed: float = 1.3
    per_edit: float = 0.8


def edits_allowed(term: str) -> int:
    letters = len(term.removesuffix("*"))
    return 0 if letters < 5 else 1 if letters < 8 else 2


class Matcher:
    """Best lexicon term for a word: (term, edits), or None.  A stem is held
    against every beginning of the word; at equal edits a word goes first."""

    def __init__(self, terms: dict[str, float], edits: dict[str, int] | None = None):
        """``edits``: most edits of a term, where fewer than its length allows."""
        self.terms = terms
        self.allowed = allowed = {t: (edits or {}).get(t, edits_allowed(t)) for t in terms}
        self.child, self.full, self.stem, self.room = [{}], {}, {}, [0]
        for term in sorted(terms):
            at, most = 0, allowed[term]
            self.room[0] = max(self.room[0], most)
            for c in term.removesuffix("*"):
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.room.append(0)
                at = self.child[at][c]
                self.room[at] = max(self.room[at], most)      # edits any term below allows
            (self.stem if term.endswith("*") else self.full)[at] = term
        self.states, self.sets, self.next, self.found = {}, [], [], []
        self.start = self._state({0: 0})
        self.memo: dict[str, tuple[str, int] | None] = {}

    def _state(self, reached: dict[int, int]) -> int:
        """Number of a state; letters of a term may be missing in the word."""
        todo = list(reached)
        while todo:
            n = todo.pop()
            for to in self.child[n].values():
                e = reached[n] + 1
                if e <= self.room[to] and e < reached.get(to, 99):
                    reached[to] = e
                    todo.append(to)
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(reached)
            self.next.append({})
            ends = [(e, 0, self.full[n]) for n, e in reached.items() if n in self.full and e <= self.allowed[self.full[n]]]
            stems = [(e, 1, self.stem[n]) for n, e in reached.items() if n in self.stem and e <= self.allowed[self.stem[n]]]
            self.found.append((min(ends, default=None), min(stems, default=None)))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        """-1: no term can be reached any more."""
        to: dict[int, int] = {}
        for n, e in self.sets[state].items():
            for k, m in self.child[n].items():
                d = e + (k != c)
                if d <= self.room[m] and d < to.get(m, 99):
                    to[m] = d
            if e + 1 <= self.room[n] and e + 1 < to.get(n, 99):
                to[n] = e + 1
        return self._state(to) if to else -1

    def match(self, word: str) -> tuple[str, int] | None:
        try:
            return self.memo[word]
        except KeyError:
            pass
        state, best = self.start, None
        for c in word:
            after = self.next[state].get(c)
            if after is None:
                after = self._step(state, c)
                if len(self.next[state]) < 4096:
                    self.next[state][c] = after
            state = after
            if state < 0:
                break
            if self.found[state][1] and (best is None or self.found[state][1] < best):
                best = self.found[state][1]
        if state >= 0 and self.found[state][0] and (best is None or self.found[state][0] < best):
            best = self.found[state][0]
        if len(self.memo) >= 400_000:
            self.memo.clear()
        self.memo[word] = (best[2], best[0]) if best else None
        return self.memo[word]


FEATURES = ("weight", "strongest", "terms", "density", "words")


def features(text: str | None, m: Matcher, p: Params) -> list[float]:
    low = text.lower() if text else ""
    words = WORDS.findall(low)
    if not words:
        return [0.0] * len(FEATURES)
    size = math.log1p(len(words))
    if not any(m.match(w) for w in set(words)):
        return [0.0, 0.0, 0.0, 0.0, size]
    places = list(WORDS.finditer(low))
    hits = [(i, h) for i, w in enumerate(words) if (h := m.match(w))]
    total, strongest, seen = 0.0, 0.0, set()
    at = {i for i, _ in hits}
    for i, (term, edits) in hits:
        near = range(max(0, i - p.window), min(len(words), i + p.window + 1))
        left, right = low[places[near[0]].start():places[i].start()], low[places[i].end():places[near[-1]].end()]
        quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
        factor = 1.0
        if quoted or any(words[j] in REPORTING for j in near if j < i):
            factor = p.reported
        elif any(words[j] in ADDRESS or (j != i and j in at) for j in near):
            factor = p.addressed
        v = m.terms[term] * p.per_edit ** edits * factor
        total, strongest = total + v, max(strongest, v)
        seen.add(term)
    return [math.log1p(total), strongest, math.log1p(len(seen)), math.log1p(100 * total / len(words)), size]


# -- learning ---------------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """(text, toxic) of the labelled sample, and per class (rows, rate)."""
    one = written(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                        .where("toxic in (0, 1)"), "toxicity-labels")
    rows = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {t: min(1.0, p.sample_rows / n) for t, n in rows.items()}
    keep = F.lit(False)
    for t, q in rate.items():
        keep = keep | ((F.col("toxic") == t) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(q * (1 << 20))))
    thin = written(one.where(keep), "toxicity-thin")               # about sample_rows per class
    # one row per labelled document, also where rows repeat an id
    got = docs.select("doc_id", "text").join(F.broadcast(thin), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("of"), F.first("toxic").alias("toxic")).select("of.text", "toxic")
    return written(got, "toxicity-sample"), {t: (rows[t], rate[t]) for t in rows}


def learn_lexicon(labelled: DataFrame, p: Params) -> dict[str, float]:
    """Terms with the log of their lift.  Counts are combined per batch, then
    summed by Spark; only terms over the bounds reach the driver."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    least, most = p.stems

    def count(batches):
        for b in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                terms = set(WORDS.findall(text.lower())) if text else set()
                terms |= {w[:k] + "*" for w in terms for k in range(least, min(most, len(w) - 1) + 1)}
                by[toxic].update(terms)
            names = list(by[0].keys() | by[1].keys())
            yield batch(schema, [names, [by[1][n] for n in names], [by[0][n] for n in names]])

    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}
    lift = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    found = (labelled.mapInArrow(count, "term string, toxic long, clean long").groupBy("term")
                     .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("lift", lift)
                     .where((F.col("toxic") >= max(3, p.support * sizes[1])) & (F.col("lift") >= p.lift))
                     .withColumn("worth", F.col("toxic") * F.log("lift"))
                     .orderBy(F.desc("worth"), F.desc(F.length("term")), "term").limit(40 * p.max_terms).collect())
    return choose([(r["term"], r["toxic"], math.log(r["lift"])) for r in found], p)


def choose(found: list[tuple[str, int, float]], p: Params) -> dict[str, float]:
    """Of (term, toxic documents, weight), worthiest first: the stems that add
    clearly to each of their words, one of a chain, and the words, save those
    that tell only a small part of a stem taken."""
    best: dict[str, int] = {}                                     # stem -> most toxic documents of one word of it
    for term, toxic, _ in found:
        for k in range(p.stems[0], 0 if term.endswith("*") else len(term)):
            best[term[:k]] = max(best.get(term[:k], 0), toxic)
    kept: dict[str, float] = {}
    chains: dict[str, int] = {}                                   # stem taken -> its toxic documents
    for term, toxic, weight in found:
        bare = term.removesuffix("*")
        if len(kept) >= p.max_terms:
            break
        if term.endswith("*"):
            if toxic >= p.adds * best.get(bare, 0) and not any(k.startswith(bare) or bare.startswith(k) for k in chains):
                chains[bare] = toxic
                kept[term] = weight
        elif not any(bare.startswith(k) and toxic < p.word_part * n for k, n in chains.items()):
            kept[term] = weight
    return kept


def learn_edits(labelled: DataFrame, terms: dict[str, float], p: Params) -> dict[str, int]:
    """Most edits of the terms whose misspellings are other words: as many as
    the term stays telling with, all rows found by it taken together."""
    schema = pa.schema([("term", pa.string()), ("edits", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        m = Matcher(terms)
        for b in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                by[toxic].update({h for w in set(WORDS.findall(text.lower())) if (h := m.match(w))} if text else ())
            names = list(by[0].keys() | by[1].keys())
            yield batch(schema, [[t for t, _ in names], [e for _, e in names], [by[1][n] for n in names], [by[0][n] for n in names]])

    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = (labelled.mapInArrow(count, "term string, edits int, toxic long, clean long").groupBy("term", "edits")
                     .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect())
    most: dict[str, int] = {}
    rows: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["term"], r["edits"])):
        have = rows.setdefault(r["term"], [0, 0])
        have[0] += r["toxic"]
        have[1] += r["clean"]
        if r["edits"] and (have[0] + 0.5) / (sizes[1] + 1) < p.lift * (have[1] + 0.5) / (sizes[0] + 1):
            most.setdefault(r["term"], r["edits"] - 1)
    return most


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + np.diag(keep), x.T @ (w * (y - q)) - keep * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass(frozen=True)
class Model:
    terms: dict
    coefficients: tuple
    params: Params
    edits: dict = field(default_factory=dict)

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.edits)

    def score(self, text: str | None, m: Matcher) -> float:
        if not self.coefficients:
            return 0.0
        z = sum(a * b for a, b in zip(features(text, m, self.params), self.coefficients)) + self.coefficients[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    with scratch_scope(docs.sparkSession):
        labelled, classes = sample(docs, labels, p)
        terms = learn_lexicon(labelled, p)
        if not terms:
            return Model({}, (), p)
        edits = learn_edits(labelled, terms, p)

        def run(batches):
            m = Matcher(terms, edits)
            for b in batches:
                got = [features(t, m, p) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int64()), pa.array(got, pa.list_(pa.float64()))], names=["y", "x"])

        seen = labelled.mapInArrow(run, "y long, x array<double>").orderBy("y", "x").collect()       # the bounded sample
        x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
        w = np.where(y == 1, 1 / classes[1][1], 1 / classes[0][1])
        return Model(terms, tuple(float(v) for v in fit(x, y, w / w.mean())), p, edits)


def scored(docs: DataFrame, model: Model, whole: bool = False) -> DataFrame:
    """All columns of ``docs`` (``whole``) or its doc_id as a struct ``row``
    (so that names cannot clash), with ``score`` and ``predicted`` (1 from 0.5
    on)."""
    df = docs.select(F.struct("*").alias("row")) if whole else docs.select(F.struct("doc_id").alias("row"), "text")

    def run(batches):
        m = model.matcher()
        for b in batches:
            row = b.column("row")
            s = [model.score(t.as_py(), m) for t in (row.field("text") if whole else b.column("text"))]
            yield pa.RecordBatch.from_arrays([row, pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())],
                                             names=["row", "score", "predicted"])

    return df.mapInArrow(run, T.StructType([df.schema["row"]]).add("score", "double").add("predicted", "integer"))


def predictions(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  Rows whose
    crc32(doc_id) mod 5 is 0 are held out of learning."""
    model = learn(docs, labels.where(remainder("doc_id", 5) != 0), p)
    held = remainder("doc_id", 5) == 0
    out = scored(docs, model).select("row.doc_id", "score", "predicted")
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    return scored(docs, learn(docs, labels, p), whole=True).where("predicted = 0").select("row.*")
