"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with scores from the words around each hit.

The lexicon is learned from labels: words, and beginnings of words, that documents marked toxic hold far more often
than others. A word of a text is a Levenshtein automaton (bit sets of positions, one for each number of edits) that
walks the trie, so misspelled terms are found. A document's features say how many hits it has, how they cluster, and
how many stand in quotation marks; a small logistic regression turns them into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.llm.common import chunks, filter_by_text, fold, texts
from markertree.llm.quality import labelled_sample
from markertree.llm.simhash import shingle_hashes
from markertree.session import discard, materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_~`“”„‘’«»…"
QUOTES = "\"“”„«»‘’"
SAMPLE_ROWS = 25_000
"""Bound on the labelled rows that lexicon and score are learned from; a hash of the id picks them."""
LEAST_TOXIC = 3
"""Least toxic documents that a term must be in. Its likelihood-ratio statistic must pass twice the logarithm of the number
of terms tested, so that chance puts about one term into the lexicon at any size of the sample."""
PREFIXES = range(4, 9)
WINDOW = 6
"""Words on either side that a hit is judged by."""
CACHED_WORDS = 1 << 18
MISSPELLED = 0.8
"""Share of its weight that a term keeps for each edit."""


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Terms by letter; ``term*`` matches every word that begins so, other terms match within their allowed edits."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.root: dict = {}
        self.parts: set[str] = set()
        self.prefixes = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        for term in weights:
            if term.endswith("*"):
                continue
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
            k = edits_allowed(term)
            # k edits leave one of k + 1 parts whole, so a word without any part is far from every term
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            self.parts.update(term[a:b] for a, b in zip(cuts, cuts[1:]))
        self.part_sizes = sorted({len(p) for p in self.parts})
        self.longest = max((len(t) + edits_allowed(t) for t in weights if not t.endswith("*")), default=0)
        self.prefix_sizes = sorted({len(p) for p in self.prefixes})

    def match(self, word: str) -> tuple[float, int, str] | None:
        """(weight, edits, term) of the best term: fewest edits, then most weight, then first by name."""
        for n in self.prefix_sizes:
            if word[:n] in self.prefixes:
                return self.prefixes[word[:n]], 0, word[:n] + "*"
        if len(word) > self.longest or not any(
                word[i:i + n] in self.parts for n in self.part_sizes for i in range(len(word) - n + 1)):
            return None
        where: dict[str, int] = {}
        for i, letter in enumerate(word):
            where[letter] = where.get(letter, 0) | 1 << i
        best = None
        # bit i of states[e]: the first i letters of the word agree with the path so far by e edits
        stack = [(self.root, (1, 3, 7))]
        while stack:
            node, states = stack.pop()
            for letter, below in node.items():
                if letter == "":
                    k = edits_allowed(below)
                    if min(len(word), len(below)) < 5:
                        k = 0
                    for e in range(k + 1):
                        if states[e] >> len(word) & 1:
                            found = (e, -self.weights[below], below)
                            best = found if best is None or found < best else best
                            break
                    continue
                here = where.get(letter, 0)
                s0 = (states[0] & here) << 1
                s1 = (states[1] & here) << 1 | states[0] | states[0] << 1 | s0 << 1
                s2 = (states[2] & here) << 1 | states[1] | states[1] << 1 | s1 << 1
                if s0 | s1 | s2:
                    stack.append((below, (s0, s1, s2)))
        return None if best is None else (-best[1], best[0], best[2])


@dataclass
class Model:
    weights: dict[str, float]
    clean: set[str]
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.coefficients[0] + (x - self.mean) / self.spread @ self.coefficients[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


FEATURES = 6


class Scanner:
    """Finds hits in texts; remembers the words it has looked up."""

    def __init__(self, weights: dict[str, float], clean: set[str]):
        self.trie, self.clean, self.known = Trie(weights), clean, {}

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text)
        known = self.known
        for w in set(words).difference(known):
            if len(known) >= CACHED_WORDS:
                known.clear()
                known.update((x, self._look(x)) for x in set(words))
                break
            known[w] = self._look(w)
        hits = [(i, h) for i, h in enumerate(map(known.__getitem__, words)) if h is not None]
        if not hits:
            return [0.0] * FEATURES
        quoted, cluster, weight, terms = 0, 0, 0.0, set()
        at = [i for i, _ in hits]
        for n, (i, (w, edits, term)) in enumerate(hits):
            before = " ".join(words[max(0, i - WINDOW):i + 1])[:-len(words[i].lstrip(QUOTES)) or None]
            after = words[i].lstrip(QUOTES) + " " + " ".join(words[i + 1:i + 1 + WINDOW])
            inside = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            quoted += inside
            near = n - next(j for j in range(n, -1, -1) if j == 0 or i - at[j - 1] > WINDOW)
            cluster = max(cluster, near)
            scale = 0.25 if inside else 1.0
            weight += scale * w * MISSPELLED ** edits
            terms.add(term)
        n = len(hits)
        return [math.log1p(max(weight, 0.0)), math.log1p(len(terms)), float(n > 1),
                quoted / n, math.log1p(cluster), math.log1p(100.0 * n / len(words))]

    def _look(self, raw: str) -> tuple[float, int, str] | None:
        word = raw.strip(EDGE).lower()
        found = self.trie.match(word) if word else None
        return None if found and found[1] and word in self.clean else found


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of each text's shingles, by which near copies are told."""
    for batch in chunks(batches):
        found = [shingle_hashes(t) for t in batch.column("text").to_pylist()]
        first = [int(h.min()) - (1 << 63) if len(h) else 0 for h in found]
        second = [int((h * np.uint64(0x9E3779B97F4A7C15)).min()) - (1 << 63) if len(h) else 0 for h in found]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "text", "y")), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
            ["doc_id", "text", "y", "first", "second"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        term, label = [], []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            words = {w.strip(EDGE).lower() for w in WORD.findall(text)}
            found = words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}
            found.discard("")
            term += found
            label += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(label, pa.int32())], ["term", "y"])


def lexicon(sample: DataFrame) -> tuple[dict[str, float], set[str]]:
    """Terms with their log odds, and the clean words near a term, from (doc_id, text, y) rows of a bounded sample; near copies count once."""
    signed = sample.mapInArrow(_signatures, "doc_id long, text string, y int, first long, second long")
    # of near copies the smallest id stands, whatever the order of the rows
    apart = signed.groupBy("first").agg(F.min(F.struct("doc_id", "text", "y", "second")).alias("r")).select("r.*")
    once = materialize(apart.groupBy("second").agg(F.min(F.struct("doc_id", "text", "y")).alias("r")).select("r.text", "r.y"))
    try:
        by_label = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
        n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
        if not n1 or not n0:
            return {}, set()
        counts = materialize(once.mapInArrow(_terms, "term string, y int").groupBy("term").agg(
            F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b")
        ).filter(F.col("a") + F.col("b") >= LEAST_TOXIC))
        least = 2.0 * math.log(max(2, counts.count()))
        total, xlogx = F.col("a") + F.col("b"), lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
        p1 = n1 / (n0 + n1)
        g = 2 * (xlogx(F.col("a"), total * p1) + xlogx(F.col("b"), total * (1 - p1)))
        odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
        rows = counts.select("term", "a", g.alias("g"), odds.alias("w")).filter(
            (F.col("a") >= LEAST_TOXIC) & (F.col("g") >= least) & (F.col("w") >= 2.0)
        ).orderBy(F.desc("g"), "term").collect()  # terms of a bounded sample that pass the test
    finally:
        discard(once)
    chosen: dict[str, float] = {}
    heads = {r["term"][:-1]: r["g"] for r in rows if r["term"].endswith("*")}
    for r in rows:
        # whole words stay, as only they are matched with edits; of beginnings, those that tell more than each shorter one
        stem = r["term"][:-1]
        if not r["term"].endswith("*") or all(heads.get(stem[:n], -1.0) < r["g"] for n in PREFIXES if n < len(stem)):
            chosen[r["term"]] = r["w"]
    # a word that clean documents use is no misspelling
    shared = sample.sparkSession.sparkContext.broadcast(chosen)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            words = batch.column("term").to_pylist()
            found = [w for w, m in zip(words, map(trie.match, words)) if m is not None and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["term"])

    clean = counts.filter((F.col("b") >= LEAST_TOXIC) & ~F.col("term").endswith("*")).select("term")
    return chosen, {r["term"] for r in clean.mapInArrow(near, "term string").collect()}


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> Model:
    """Learn from a bounded sample of labelled rows whose id's crc32 modulo 5 is not ``held_out``.

    One fold of the others fits the score, the rest the lexicon, so the score isn't fitted on the lexicon's own rows.
    Without labels of both kinds all scores are 0.
    """
    sample = labelled_sample(docs, labels, "toxic", SAMPLE_ROWS).filter(fold("doc_id", 5) != held_out)
    judge = (held_out + 4) % 5
    weights, clean = lexicon(sample.filter(fold("doc_id", 5) != judge))
    shared = docs.sparkSession.sparkContext.broadcast((weights, clean))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch in chunks(batches):
            x = [scanner.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    rows = sample.filter(fold("doc_id", 5) == judge).select("text", "y").mapInArrow(
        measure, "x array<double>, y int").toPandas()  # at most SAMPLE_ROWS short rows
    model = Model(weights, clean)
    y = rows["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        model.coefficients[0] = -40.0
        return model
    x = np.array(rows["x"].tolist())
    model.mean, model.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    design = np.column_stack([np.ones(len(x)), (x - model.mean) / model.spread])
    ridge = np.diag([1e-6] + [0.1] * FEATURES)
    beta = np.zeros(FEATURES + 1)
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(design.T @ (design * v[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta = beta + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    model.coefficients = beta
    return model


def score(docs: DataFrame, model: Model, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null and empty texts have no hits and get a score too.

    Repeated rows are kept; columns other than doc_id and text are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value.weights, shared.value.clean)
        for batch in chunks(batches):
            x = np.array([scanner.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold("doc_id", 5) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic (score 0.5 or more); columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        scanner = Scanner(shared.value.weights, shared.value.clean)
        return lambda batch: shared.value.score(
            np.array([scanner.features(t) for t in batch]).reshape(-1, FEATURES)) < 0.5

    return filter_by_text(docs, judge)
