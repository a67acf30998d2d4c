"""Toxicity by a fuzzy lexicon in its context.

The lexicon is a fixed list of insults and the words that labelled toxic
documents have much more often than others.  A Levenshtein automaton run
along the lexicon's trie finds every word within the allowed distance of a
term: a letter more, less or other, or two letters swapped, is one edit.
Fixed terms allow one from ``one_edit_from`` letters and two from
``two_edits_from``, learned ones one from ``learned_edit_from``.  The product
automaton is made deterministic as it is used, so a word costs one table step
a letter.  Each hit looks at the words around it:
quotation marks and reporting verbs speak for a quotation, second persons
and forms of "be" for abuse.  A logistic model over the sums gives the score.

What is fitted: the lexicon from word counts of a bounded sample of labelled
documents (Spark aggregations; ``max_terms`` rows reach the driver), the
model from the same documents' feature sums.  Clean words near a term that
several documents of the sample have are no hits; they are words of that
bounded sample, and only those within a term's distance reach the driver.

Defined results: null or empty text has no hits and the score of the
intercept; without labelled rows of both kinds the fixed lexicon and fixed
weights are used; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.scratch import Scratch

#: Insults, in natural order.
INSULTS = "arsehole asshole bastard bitch clown crap creep cretin cunt dick dickhead disgusting dumb dumbass fool freak fuck garbage idiot imbecile jerk loser lunatic maggot moron nazi pathetic pervert pig psycho retard scum shit slut stupid trash useless vermin whore worthless idiota estúpido imbécil tonto basura connard crétin imbécile salaud arschloch dummkopf idiotin trottel"
#: Words that address somebody, and words that report speech.
ADDRESS = frozenset("you your yours yourself u ur are is was be were du dich dir dein deine ihr sie ist bist bin tu te toi vous ton ta es est êtes usted tú ti eres eso esa".split())
REPORT = frozenset("said says say quoted quote wrote writes called reported reads word term phrase meaning defined sagte schrieb nannte dit écrit appelle dijo escribió llamó".split())
#: A word may hold digits, underscores and the signs that letters are hidden behind.
WORD = re.compile(r"[^\W_][\w*@$!'-]*[^\W_]|[^\W_]|[\"“”«»„]")
LETTERS = re.compile(r"[^\W\d_]+")
QUOTES = frozenset("\"“”«»„")
FEATURES = 8


@dataclass(frozen=True)
class Lexicon:
    """Sample, size of the lexicon, distances and context of a hit."""

    sample: int = 20_000
    max_terms: int = 3_000
    min_docs: int = 3
    min_lift: float = 8.0
    one_edit_from: int = 4
    two_edits_from: int = 8
    learned_edit_from: int = 5
    fixed: frozenset[str] = frozenset(INSULTS.split())
    window: int = 6
    max_states: int = 200_000
    holdout: int = 2
    parts: int = 4


class Automaton:
    """Words near a lexicon term, as a lazily made DFA.

    A state is a set of (trie node, edits so far, letter that ends a swap);
    ``step`` tables are kept, and dropped as a whole when they reach
    ``max_states`` (they are then made again as needed, so results don't
    change).
    """

    def __init__(self, terms: dict[str, float], s: Lexicon):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        #: Most edits that any term below a node allows.
        self.most: list[int] = [0]
        self.terms, self.settings = terms, s
        for t in terms:
            node, edits = 0, self.allowed(t)
            self.most[0] = max(self.most[0], edits)
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], edits)
            self.term[node] = t
        self._clear()

    def allowed(self, term: str) -> int:
        """Edits that a term allows."""
        s = self.settings
        if term not in s.fixed:
            return int(len(term) >= s.learned_edit_from)
        return (len(term) >= s.one_edit_from) + (len(term) >= s.two_edits_from)

    def _clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        # a letter that the word lacks is a step along the trie without one
        least: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, edits, swap = todo.pop()
            if edits > self.most[node] or least.get((node, swap), 9) <= edits:
                continue
            least[node, swap] = edits
            if not swap:
                todo += [(n, edits + 1, "") for n in self.next[node].values()]
        key = frozenset((n, e, x) for (n, x), e in least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(e, -self.terms[t], t) for n, e, x in key if not x and (t := self.term[n]) is not None and e <= self.allowed(t)]
            self.ends.append((min(hits)[2], min(hits)[0]) if hits else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, swap in self.sets[state]:
            after = self.next[node]
            if swap:
                # the first of two swapped letters was read; this is the other
                if swap == c:
                    out.add((node, edits, ""))
                continue
            if c in after:
                out.add((after[c], edits, ""))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
                for a, n in after.items():
                    out.add((n, edits + 1, ""))
                    if c in self.next[n] and a != c:
                        out.add((self.next[n][c], edits + 1, a))
        new = self._state(out) if out else -1
        if new >= 0 and not self.sets[new]:
            new = -1
        self.moves[state][c] = new
        return new

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, or None."""
        if len(self.sets) > self.settings.max_states:
            self._clear()
        state = self.start
        for c in word:
            after = self.moves[state].get(c)
            state = self._move(state, c) if after is None else after
            if state < 0:
                return None
        return self.ends[state]


@dataclass
class Scorer:
    """Lexicon, clean vocabulary near it, and the model's weights."""

    terms: dict[str, float]
    spared: frozenset[str]
    settings: Lexicon
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 0.8, 0.5, -0.5, 0.5, 2.0, 0.5, 1.0]))

    def __post_init__(self) -> None:
        self._automaton: Automaton | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def features(self, texts: Iterator[str | None]) -> Iterator[list[float]]:
        """Sums over the hits of each text; the last one is their number."""
        s = self.settings
        if self._automaton is None:
            self._automaton = Automaton(self.terms, s)
        known: dict[str, tuple[str, int] | None] = {}
        for text in texts:
            words = WORD.findall((text or "").lower())
            hits = []
            for i, w in enumerate(words):
                found = known.get(w, 0)
                if found == 0:
                    if len(known) > s.max_states:
                        known.clear()
                    found = known[w] = self._match(w)
                if found:
                    hits.append((i, *found))
            yield self._sums(words, hits)

    def _match(self, word: str) -> tuple[str, int] | None:
        """The term that a word, or else a part between its signs, is near to."""
        found = self._automaton.match(word)
        if found and found[1] and word in self.spared:
            found = None
        if found is None and not word.isalpha():
            parts = {*LETTERS.findall(word), "".join(c for c in word if c.isalnum())} - {word}
            hits = [x for part in parts if (x := self._match(part))]
            found = min(hits, key=lambda x: (x[1], x[0]), default=None)
        return found

    def _sums(self, words: list[str], hits: list[tuple[int, str, int]]) -> list[float]:
        exact = fuzzy = best = quoted = abuse = 0.0
        k = self.settings.window
        for i, term, edits in hits:
            weight = self.terms[term]
            around = words[max(0, i - k) : i] + words[i + 1 : i + 1 + k]
            before, after = words[max(0, i - k) : i], words[i + 1 : i + 1 + k]
            marks = any(w in QUOTES for w in before) and any(w in QUOTES for w in after)
            told = marks or any(w in REPORT for w in before)
            aimed = any(w in ADDRESS for w in around)
            quoted += weight if told else 0.0
            abuse += weight if aimed and not told else 0.0
            if edits:
                fuzzy += weight
            else:
                exact += weight
            best = max(best, weight / (1 + edits))
        n = len(words) or 1
        rate = (exact + fuzzy) / n
        distinct = len({t for _, t, _ in hits})
        return [np.log1p(exact), np.log1p(fuzzy), best, np.log1p(quoted), np.log1p(abuse), min(1.0, 20 * rate), min(distinct, 5), min(len(hits), 10) / 10, len(hits)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + x[:, :FEATURES] @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Intercept and weights by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(a) * np.eye(a.shape[1])
        w = w - np.linalg.solve(h, a.T @ (p - y) + ridge * len(a) * w)
    return w


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def sample_of(docs: DataFrame, labels: DataFrame, column: str, s) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``s.sample`` labelled rows.

    Rows come in the order of a hash of the id; held-out ids take no part.
    """
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), s.parts) != s.holdout))
    chosen = usable.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample).select("doc_id", F.col(column).cast("int").alias("label"))
    # at most ``sample`` pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn_terms(rows: DataFrame, s: Lexicon) -> tuple[dict[str, float], frozenset[str]]:
    """Terms with their weights, and frequent words that are clean.

    Counts are of documents; every word of the sample is counted, and only
    the rows that the lexicon takes reach the driver.
    """
    n1, n0 = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    terms = dict.fromkeys(INSULTS.split(), 1.0)
    if not n1 or not n0:
        return terms, frozenset()
    found = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    counts = rows.select("label", F.explode(found).alias("word")).groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    counts = Scratch(rows.sparkSession).keep(counts, "counts")
    lift = ((F.col("bad") + 0.1) / n1) / ((F.col("good") + 1.0) / n0)
    top = counts.where(F.col("bad") >= s.min_docs).withColumn("lift", lift).where(F.col("lift") >= s.min_lift).orderBy(F.desc(F.col("bad") * F.log("lift")), "word").limit(s.max_terms).collect()
    learned = {r.word: min(float(np.log(r.lift)) / 3, 2.0) for r in top}
    terms = {**{k: v for k, v in terms.items()}, **learned}
    common = counts.where((F.col("good") >= s.min_docs) & (F.col("bad") * float(n0) < F.col("good") * float(n1) * s.min_lift)).select("word")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Automaton(terms, s)
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if own.match(w)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    spared = frozenset(r.word for r in common.mapInArrow(near, "word string").collect())
    return {t: v for t, v in terms.items() if t in learned or t not in spared}, spared


def fit(docs: DataFrame, labels: DataFrame, s: Lexicon = Lexicon()) -> Scorer:
    """Lexicon and model from the labelled rows of ``docs``."""
    rows = sample_of(docs, labels, "toxic", s)
    terms, spared = learn_terms(rows, s)
    scorer = Scorer(terms, spared, s)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = list(shared.value.features(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = rows.select("text", "label").mapInArrow(sums, "x array<double>, label int").collect()
    y = np.array([r.label for r in got], float)
    if len(y) and 0 < y.sum() < len(y):
        scorer.weights = fit_logistic(np.array([r.x[:FEATURES] for r in got]), y)
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``(doc_id, score, n_terms)`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(list(shared.value.features(batch.column(1).to_pylist())), float).reshape(-1, FEATURES + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.probability(x)), pa.array(x[:, FEATURES].astype(np.int64))], names=["doc_id", "score", "n_terms"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, score double, n_terms bigint")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Lexicon = Lexicon()) -> DataFrame:
    """The rows of the ``op5`` query."""
    out = score(docs, fit(docs, labels, s))
    return out.select("doc_id", (remainder(F.col("doc_id"), s.parts) == s.holdout).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms")
