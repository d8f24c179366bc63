"""Quality rules: counted rules, then a calibrated logistic regression on hashed word and character n-grams.

Texts are read in Arrow batches. A text's features are the means, over its word 1-grams and 2-grams and its byte 3-grams
and 4-grams, of one weight for each hash bucket; so a score is four gathers and four segment sums, whatever the length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.llm.common import chunks, filter_by_text, fold, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
BITS = 18
"""Hash buckets of each kind of n-gram: 2 ** BITS."""
KINDS = ("word 1-gram", "word 2-gram", "byte 3-gram", "byte 4-gram")
TRAINING_ROWS = 16_000
"""Bound on the labelled rows that the regression is fitted on, a fifth of them for calibration; a hash of the id picks them."""
SHARDS = 8
REJECT_BELOW = 0.5
"""Fixed threshold on the calibrated probability of good quality."""
LEAST_WORDS, MOST_REPEATED = 10, 20
SCALE = 32.0
"""Feature means are multiplied by this, so that steps on rare buckets are large enough."""


@dataclass
class Model:
    weights: np.ndarray
    """One row of 2 ** BITS weights for each of KINDS."""
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))


class Texts:
    """The words of some texts as numbers, and the hash buckets of all their n-grams with the text each is in."""

    def __init__(self, batch: list[str]):
        words = [WORD.findall(t) for t in batch]
        self.n = len(batch)
        self.n_words = np.fromiter(map(len, words), np.int64, self.n)
        flat = [w for part in words for w in part]
        self.word_chars = _segment_sum(np.fromiter(map(len, flat), np.int64, len(flat)), self.n_words)
        number: dict[str, int] = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        self.ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        self.word_hash = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in number], np.uint64)
        self.batch = batch

    def repeated_words(self, width: int = 5) -> np.ndarray:
        """Words in ``width``-word windows that a text holds twice or more, the first included."""
        n = len(self.ids) - width + 1
        out = np.zeros(self.n, np.int64)
        if n <= 0:
            return out
        doc = np.repeat(np.arange(self.n), self.n_words)
        inside = doc[:n] == doc[width - 1:]
        at = np.nonzero(inside)[0]
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = (h ^ self.ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h ^= doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(h, kind="stable")
        a, b = at[order[:-1]], at[order[1:]]
        same = (h[order[:-1]] == h[order[1:]]) & (doc[a] == doc[b])
        a, b = a[same], b[same]
        equal = np.ones(len(a), bool)
        for k in range(width):
            equal &= self.ids[a + k] == self.ids[b + k]
        marked = np.zeros(len(self.ids), bool)
        for start in (a[equal], b[equal]):
            for k in range(width):
                marked[start + k] = True
        return _segment_sum(marked.astype(np.int64), self.n_words)

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of KINDS: bucket of every n-gram, in order of text, and n-grams in each text."""
        mask = np.uint64((1 << BITS) - 1)
        h = _mix(self.word_hash[self.ids]) if len(self.ids) else np.empty(0, np.uint64)
        yield (h & mask).astype(np.int32), self.n_words
        doc = np.repeat(np.arange(self.n), self.n_words)
        pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:])[doc[:-1] == doc[1:]]
        yield (pair & mask).astype(np.int32), np.maximum(self.n_words - 1, 0)
        raw = [t.encode("utf-8", "surrogatepass") for t in self.batch]
        size = np.fromiter(map(len, raw), np.int64, self.n)
        b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), size)
        for n in (3, 4):
            if len(b) < n:
                yield np.empty(0, np.int32), np.zeros(self.n, np.int64)
                continue
            g = np.zeros(len(b) - n + 1, np.uint32)
            for k in range(n):
                g = g << np.uint32(8) | b[k:len(b) - n + 1 + k]
            g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            yield g[doc[:len(g)] == doc[n - 1:]].astype(np.int32), np.maximum(size - n + 1, 0)

    def scores(self, model: Model) -> np.ndarray:
        z = np.full(self.n, model.bias)
        for w, (bucket, count) in zip(model.weights, self.buckets()):
            z += SCALE * _segment_sum(w[bucket], count) / np.maximum(count, 1)
        return z

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Index into the flattened weights and value of the features of each text."""
        index: list[list[np.ndarray]] = [[] for _ in range(self.n)]
        value: list[list[np.ndarray]] = [[] for _ in range(self.n)]
        for kind, (bucket, count) in enumerate(self.buckets()):
            for i, part in enumerate(np.split(bucket, np.cumsum(count)[:-1])):
                u, c = np.unique(part, return_counts=True)
                index[i].append((u + (kind << BITS)).astype(np.int32))
                value[i].append((SCALE * c / max(1, len(part))).astype(np.float32))
        return [(np.concatenate(i), np.concatenate(v)) for i, v in zip(index, value)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most about ``rows`` labelled documents, picked by a hash of doc_id; null labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return texts(docs).filter(picked).join(known.filter(picked), "doc_id")


def _fit_shard(epochs: int, rate: float):
    def run(key, table):
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("y").to_pylist()))
        rows.sort(key=lambda r: zlib.crc32(b"%d" % r[0]))
        found = [f for at in range(0, len(rows), 64) for f in Texts([r[1] for r in rows[at:at + 64]]).features()]
        y = [r[2] for r in rows]
        del rows, table
        # two large arrays go back to the system when the shard is done; thousands of small ones stay with the worker
        ends = np.cumsum([0] + [len(i) for i, _ in found])
        every, values = np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found])
        found = [(every[a:b], values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        w, seen, bias = np.zeros(len(KINDS) << BITS), np.full(len(KINDS) << BITS, 1e-2), 0.0
        heavy = {1: 1.0, 0: min(8.0, max(1.0, sum(y) / max(1, len(y) - sum(y))))}
        for _ in range(epochs):
            for (index, value), label in zip(found, y):
                p = 1.0 / (1.0 + np.exp(-np.clip(bias + w[index] @ value, -40, 40)))
                g = heavy[label] * (p - label)
                step = g * value + 1e-4 * w[index]
                seen[index] += step * step
                w[index] -= rate * step / np.sqrt(seen[index])
                bias -= 0.05 * g
        used = np.nonzero(w)[0]
        return pa.table({"at": pa.array(np.append(used, -1), pa.int64()), "w": pa.array(np.append(w[used], bias))})
    return run


def fit(sample: DataFrame, epochs: int = 6, rate: float = 0.1) -> Model:
    """Average the regressions of SHARDS parts, then calibrate on the fifth of the rows left out (Platt scaling).

    Both passes are on a bounded sample. Without rows of both labels the model accepts everything.
    """
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(SHARDS)).cast("int")
    kept_out = fold("doc_id", 5) == 0
    fitted = sample.filter(~kept_out).withColumn("shard", part).groupBy("shard").applyInArrow(
        _fit_shard(epochs, rate), "at long, w double")
    merged = fitted.groupBy("at").agg((F.sum("w") / SHARDS).alias("w")).toPandas()  # at most 4 * 2 ** BITS + 1 rows
    flat = np.zeros(len(KINDS) << BITS, np.float64)
    inner = merged["at"].to_numpy() >= 0
    flat[merged["at"].to_numpy()[inner]] = merged["w"].to_numpy()[inner]
    bias = float(merged["w"].to_numpy()[~inner].sum())
    model = Model(flat.reshape(len(KINDS), -1).astype(np.float32), bias)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1 << 20):
            z = Texts(batch.column("text").to_pylist()).scores(shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column("y")], ["z", "y"])

    held = sample.filter(kept_out).select("text", "y").mapInArrow(measure, "z double, y int").toPandas()
    z, y = held["z"].to_numpy(np.float64), held["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Model(model.weights * 0, 5.0)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0 / max(1e-6, z.std()), 0.0
    for _ in range(50):  # Newton steps on two numbers
        p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -40, 40)))
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [((p - target) * z).sum(), (p - target).sum()])
    return Model(model.weights, bias, float(a), float(b))


def fails_rules(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts with too few words or too many in repeated windows, and the number of such words."""
    repeat = t.repeated_words()
    return (t.n_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * t.n_words), repeat


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: rule counts, base_failed, probability of good quality, kept.

    A null text has no words. Documents that fail a rule, or whose probability is below the threshold, are not kept.
    Repeated rows are kept as they are; columns other than doc_id and text are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values = batch.column("text").to_pylist()
            t = Texts(values)
            dup = []
            for text in values:
                lines = [line for line in text.split("\n") if line.strip(SPACE)]
                dup.append(len(lines) - len(set(lines)))
            failed, repeat = fails_rules(t)
            p = shared.value.probability(t.scores(shared.value))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(t.n_words), pa.array(t.word_chars),
                pa.array([sum(map(x.count, SYMBOLS)) for x in values], pa.int64()), pa.array(dup, pa.int64()),
                pa.array(repeat), pa.array(failed), pa.array(p), pa.array(~failed & (p >= REJECT_BELOW))], NAMES)

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                       "n_repeat_words long, base_failed boolean, probability double, kept boolean")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]


def kept_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def passes(batch: list[str]) -> np.ndarray:
        t = Texts(batch)
        return ~fails_rules(t)[0] & (shared.value.probability(t.scores(shared.value)) >= REJECT_BELOW)

    return filter_by_text(docs, lambda: passes)
