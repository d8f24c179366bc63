"""Language-model scoring by logistic context mixing over bits.

Predictors: for contexts of 0 to 5 bytes, counts of zeros and ones for each bit of the next byte, in tables of hashed contexts.
They are gathered over all training texts as counts of byte 6-grams, which Spark sums. Mixer: the stretched predictions are
weighted by a set chosen by a gate (bit of the byte, and how often the two longest contexts were seen), learned online, batch by batch, in
every partition, and averaged. Refinement: an adaptive map from (bits so far, mixed prediction) to what came true. While
learning, a 6-gram's own occurrence is taken out of its counts. A text's score is the sum over its bytes, an end byte included.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markertree.llm.common import chunks, texts
from markertree.session import materialize

ORDER = 5
TABLE_BITS = (8, 16, 19, 21, 22, 22)
"""Slots of the hashed-context table of each order: 2 ** bits, 5 bytes each. They bound the model that is broadcast: 55 MB.
Of contexts that meet in a slot the most frequent has it, and a check byte tells the others that they are unknown."""
BASE = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS])))
SLOTS = int(BASE[-1])
LEVELS = np.array([1, 2, 4, 10, 31, 200])
"""Counts from which a context is a level better known."""
GATES = 8 * 7 * 7
INPUTS = ORDER + 2
LOGIT_STEPS = 33
FREQUENT_WORDS = 1 << 20
"""Bound on the word counts that are broadcast; other words meet their counts in a join."""
WORD_FLAG = 1 << 62
HIGH_HALF = slice(sys.byteorder == "little", None, 2)
"""Where the high halves of 64-bit numbers lie among 32-bit ones."""
CACHE_BITS = 20
LONG_WORD = 256
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
CHUNK = 1 << 18
"""Bytes of text that a task works on at once."""
MOST = 65_535
SPREAD = np.uint64(0xD6E8FEB86659FD93)
UNSPREAD = np.uint64(pow(int(SPREAD), -1, 1 << 64))
NODE = np.uint64(0xC2B2AE3D27D4EB4F * 0xD6E8FEB86659FD93 % (1 << 64))
MIXED_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 42) for b in range(256)], np.uint64)


def word_keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of each text, the end token (WORD_FLAG itself) after them, and tokens in each text.

    A key is 62 bits of a word's hash, flagged apart from 6-grams (48 bits): a polynomial in mixed bytes, taken from running sums.
    """
    joined = b"\n".join([*raw, b""])
    data = np.frombuffer(joined, np.uint8)
    space = np.concatenate((np.ones(1, bool), IS_SPACE[data]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(data), m)))) for m in (SPREAD, UNSPREAD))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(MIXED_BYTE[data] * up[:-1])))
    h = (sums[end] - sums[start]) * down[start]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():  # such polynomials meet for some very long words
        h[i] = xxhash.xxh64_intdigest(joined[start[i]:end[i]], 42)
    words = np.searchsorted(start, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))
    keys = np.insert((h >> np.uint64(2) | np.uint64(WORD_FLAG)).view(np.int64), words, WORD_FLAG)
    return keys, np.diff(words, prepend=0) + 1


def ngrams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 6-gram at every byte of each text and its end byte: nearest context byte highest, the byte itself lowest."""
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    joined = b"".join([*(b"\0" * ORDER + r + b"\0" for r in raw), b"\0\0"])
    starts = np.cumsum(size + ORDER) - size
    at = np.ones(int(size.sum()), np.int64)
    at[np.cumsum(size)[:-1]] = ORDER + 1
    at[0] = starts[0] - ORDER
    # eight bytes from the farthest context byte on, at any place: the sixth is the byte itself
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))[np.cumsum(at)]
    g = (eight & np.uint64((1 << 8 * ORDER) - 1)) << np.uint64(8) | eight >> np.uint64(8 * ORDER) & np.uint64(255)
    return g, size


def hashed_contexts(g: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of the context; with NODE times the bits so far added, that of a bit's place."""
    out = []
    for k in range(ORDER + 1):
        c = (g >> np.uint64(8 * (ORDER + 1 - k))) if k else np.zeros_like(g)
        c = (c + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((c ^ c >> np.uint64(29)) * SPREAD)
    return out


def slots(g: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit of the byte: its number, its value, and the slots and check bytes of all orders (one row an order)."""
    sym = g & np.uint64(255)
    contexts = hashed_contexts(g)
    for j in range(8):
        node = ((sym | np.uint64(256)) >> np.uint64(8 - j)) * NODE
        out, check = np.empty((ORDER + 1, len(g)), np.int64), np.empty((ORDER + 1, len(g)), np.uint8)
        for k, c in enumerate(contexts):
            h = c + node
            out[k] = BASE[k] + (h >> np.uint64(64 - TABLE_BITS[k])).astype(np.int64)
            check[k] = (h >> np.uint64(8)).astype(np.uint8)
        yield j, (sym >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64), out, check


@dataclass
class Model:
    zeros: np.ndarray | None
    ones: np.ndarray | None
    checks: np.ndarray | None
    weights: np.ndarray
    refined: np.ndarray
    """Probability of a one for each (bits so far, step of the mixed logit)."""
    packed: np.ndarray | None = None
    """``packed_slots`` of the tables, all that scoring reads; made when first scored, if not given."""

    def inputs(self, at: np.ndarray, check: np.ndarray, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and a constant (rows), and how well the two longest contexts are known; ``bit``: leave one out."""
        known = self.checks[at] == check
        n0, n1 = self.zeros[at] * known.astype(np.float32), self.ones[at] * known.astype(np.float32)
        if bit is not None:
            n1 = np.maximum(n1 - bit, 0)
            n0 = np.maximum(n0 - (1 - bit), 0)
        x = np.empty((INPUTS, at.shape[1]), np.float32)
        x[:-1] = np.log((n1 + 0.2) / (n0 + 0.2))
        x[-1] = 0.3
        level = np.searchsorted(LEVELS, (n0 + n1)[-2:], "right")
        return x, level[1] * 7 + level[0]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("in,ni->n", x, self.weights[gate]), -12, 12)

    def refine(self, logit: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Mean of the mixed probability and the adaptive map, interpolated between its steps."""
        p = 1.0 / (1.0 + np.exp(-logit))
        at = (logit + 12) * ((LOGIT_STEPS - 1) / 24)
        low = np.minimum(at.astype(np.int64), LOGIT_STEPS - 2)
        part = at - low
        seen = self.refined[node, low] * (1 - part) + self.refined[node, low + 1] * part
        return np.clip((p + seen) / 2, 1e-6, 1 - 1e-6)

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each 6-gram's last byte."""
        if self.packed is None:
            self.packed = packed_slots(self.zeros, self.ones, self.checks)
        contexts, by_input = hashed_contexts(g), np.ascontiguousarray(self.weights.T)
        whole = g & np.uint64(255) | np.uint64(256)
        product = np.ones(len(g))
        for j in range(8):
            node = whole >> np.uint64(8 - j)
            step = node * NODE
            xs, level = [], []
            for k, c in enumerate(contexts):
                h = c + step
                slot = self.packed[BASE[k]:BASE[k + 1]][(h >> np.uint64(64 - TABLE_BITS[k])).view(np.int64)]
                # a slot of another context is as an empty one
                slot *= (slot ^ h >> np.uint64(8)) & np.uint64(255) == 0
                xs.append(slot.view(np.float32)[HIGH_HALF])
                if k >= ORDER - 1:
                    level.append((slot >> np.uint64(8) & np.uint64(255)).view(np.int64))
            gate = j * 49 + level[1] * 7 + level[0]
            logit = np.float32(0.3) * by_input[-1][gate]
            for x, w in zip(xs, by_input):
                logit += x * w[gate]
            p = self.refine(np.clip(logit, -12, 12), node.view(np.int64))
            product *= np.where((whole >> np.uint64(7 - j) & np.uint64(1)).astype(bool), p, 1 - p)
        return np.log10(product)  # eight factors of at least 1e-6


def packed_slots(zeros: np.ndarray, ones: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """What scoring reads of each slot in one number: the stretched prediction (high 32 bits), how well it is known, its check byte."""
    out = np.empty(len(checks), np.uint64)
    for at in range(0, len(out), 1 << 20):
        part = slice(at, at + (1 << 20))
        n0, n1 = zeros[part].astype(np.float32), ones[part].astype(np.float32)
        x = np.log((n1 + 0.2) / (n0 + 0.2))
        level = np.searchsorted(LEVELS, n0 + n1, "right").astype(np.uint64)
        out[part] = x.view(np.uint32).astype(np.uint64) << np.uint64(32) | level << np.uint64(8) | checks[part]
    return out


_UNPACKED: dict[tuple[int, bool], tuple[np.ndarray, ...]] = {}
"""A worker's copy of the newest tables, by broadcast."""


def pack_tables(*arrays: np.ndarray) -> list[tuple[bytes, str]]:
    """Mostly empty tables, squeezed: a broadcast lies on the disk of every executor."""
    return [(zlib.compress(a.tobytes(), 1), a.dtype.str) for a in arrays]


def unpacked(shared, for_scoring: bool = False) -> tuple[np.ndarray, ...]:
    """The tables of a broadcast, or their ``packed_slots`` alone; a worker holds one of both."""
    packed = shared.value
    name = id(packed), for_scoring
    if name not in _UNPACKED:
        _UNPACKED.clear()
        tables = tuple(np.frombuffer(zlib.decompress(raw), kind) for raw, kind in packed)
        _UNPACKED[name] = (packed_slots(*tables),) if for_scoring else tables
    return _UNPACKED[name]


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of sorted runs of counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first) if len(c) else c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of words and 6-grams, summed over a partition as far as memory allows."""
    def out(keys, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    held = {"words": ([], [], 400_000), "grams": ([], [], 1_200_000)}
    for batch in chunks(batches, CHUNK):
        raw = [_lowered(t) for t in batch.column("text").to_pylist()]
        for (keys, counts, most), found in zip(held.values(), (word_keys(raw)[0], ngrams(raw)[0])):
            u, n = np.unique(found, return_counts=True)
            keys.append(u), counts.append(n)
            if sum(map(len, keys)) > most + 300_000:
                u, n = _merge(keys, counts)
                keys[:], counts[:] = [u], [n]
                if len(u) > most:
                    yield out(u, n)
                    keys.clear(), counts.clear()
    for keys, counts, _ in held.values():
        if keys:
            yield out(*_merge(keys, counts))


def corpus_counts(training: DataFrame) -> DataFrame:
    """(key, n) of all words, ends and 6-grams of the training texts."""
    rows = texts(training).select("text").mapInArrow(_count, "key long, n long")
    return materialize(rows.groupBy("key").agg(F.sum("n").alias("n")))


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
        where, zeros, ones = [], [], []
        for _, bit, at, check in slots(g):
            for row in at << 8 | check:
                u, back = np.unique(row, return_inverse=True)
                where.append(u)
                zeros.append(np.bincount(back, weights=n * (1 - bit), minlength=len(u)))
                ones.append(np.bincount(back, weights=n * bit, minlength=len(u)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).astype(np.int64)) for x in (where, zeros, ones)], ["slot", "n0", "n1"])


def _learn(shared, start: np.ndarray, refined: np.ndarray, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mass, seen = start.copy(), np.zeros(GATES), np.full((GATES, INPUTS), 1e-3)
        model = Model(*unpacked(shared), w, refined)
        for batch in batches:
            g_all = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            n_all = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            order = np.argsort(g_all * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
            for part in np.array_split(order, max(1, len(order) // 1024)):
                g, n = g_all[part], n_all[part]
                for j, bit, at, check in slots(g):
                    x, known = model.inputs(at, check, bit)
                    gate = j * 49 + known
                    p = 1.0 / (1.0 + np.exp(-model.mixed(x, gate)))
                    error = (bit - p) * n
                    total = np.bincount(gate, weights=n, minlength=GATES)
                    slope = np.stack([np.bincount(gate, weights=error * row, minlength=GATES) for row in x], axis=1)
                    seen += slope * slope
                    # steps shrink with the slopes met so far, and none is longer than its rate
                    w += rate * slope / np.sqrt(seen)
                    mass += total
        gates = np.repeat(np.arange(GATES), INPUTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(gates * INPUTS + np.tile(np.arange(INPUTS), GATES)), pa.array((w * mass[:, None]).ravel()),
             pa.array(np.repeat(mass, INPUTS))], ["at", "w", "mass"])
    return run


def _outcomes(shared, weights: np.ndarray, refined: np.ndarray):
    """Sums of ones and of all, for each (bits so far, nearest logit step), over 6-grams with their own occurrence left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*unpacked(shared), weights, refined)
        ones, total = np.zeros(256 * LOGIT_STEPS), np.zeros(256 * LOGIT_STEPS)
        for batch in batches:
            g = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            for j, bit, at, check in slots(g):
                x, known = model.inputs(at, check, bit)
                logit = model.mixed(x, j * 49 + known)
                node = ((g & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - j)).astype(np.int64)
                cell = node * LOGIT_STEPS + np.rint((logit + 12) * ((LOGIT_STEPS - 1) / 24)).astype(np.int64)
                ones += np.bincount(cell, weights=n * bit, minlength=len(ones))
                total += np.bincount(cell, weights=n, minlength=len(ones))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(ones[used]), pa.array(total[used])], ["at", "w", "mass"])
    return run


def train(counts: DataFrame, rates: tuple[float, ...] = (0.1, 0.05, 0.02)):
    """The mixing model of all 6-grams in ``counts``: (broadcast tables, weights, adaptive map). What reaches the driver is bounded by SLOTS, GATES and LOGIT_STEPS."""
    grams = counts.filter((F.col("key") >= 0) & (F.col("key") < F.lit(WORD_FLAG)))
    # neighbours in this order share contexts of every order, so few slots are in two partitions
    by_check = grams.repartitionByRange("key").mapInArrow(_slot_counts, "slot long, n0 long, n1 long").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    by_slot = by_check.groupBy(F.shiftright("slot", 8).alias("slot")).agg(F.max(F.struct(
        (F.col("n0") + F.col("n1")).alias("n"), F.col("slot").bitwiseAND(F.lit(255)).alias("check"), "n0", "n1")).alias("b")
    ).select("slot", "b.check", "b.n0", "b.n1")
    shrink = F.least(F.lit(1.0), F.lit(float(MOST)) / F.greatest("n0", "n1"))
    table = by_slot.select(F.col("slot").cast("int").alias("slot"), F.col("check").cast("short").alias("check"), F.ceil(F.col("n0") * shrink).cast("int").alias("n0"),
                           F.ceil(F.col("n1") * shrink).cast("int").alias("n1")).toArrow()
    zeros, ones, checks = np.zeros(SLOTS, np.uint16), np.zeros(SLOTS, np.uint16), np.zeros(SLOTS, np.uint8)
    at = table.column("slot").to_numpy()
    zeros[at], ones[at] = table.column("n0").to_numpy(), table.column("n1").to_numpy()
    checks[at] = table.column("check").to_numpy()
    del table
    share = np.array([0.0, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0])
    start = np.zeros((8, 7, 7, INPUTS))  # the better known a context, the less is left to shorter ones
    start[..., ORDER] = share[:, None]
    start[..., ORDER - 1] = (1 - share)[:, None] * share
    start[..., ORDER - 2] = (1 - share)[:, None] * (1 - share)
    weights = start.reshape(GATES, INPUTS)
    refined = np.tile(1 / (1 + np.exp(-np.linspace(-12, 12, LOGIT_STEPS))), (256, 1))
    shared = counts.sparkSession.sparkContext.broadcast(pack_tables(zeros, ones, checks))

    def total(run) -> pd.DataFrame:
        return grams.mapInArrow(run, "at long, w double, mass double").groupBy("at").agg(
            F.sum("w").alias("w"), F.sum("mass").alias("mass")).toPandas()

    for k, rate in enumerate(rates):
        found = total(_learn(shared, weights, refined, rate, k))
        weights = weights.ravel().copy()
        some = found["mass"].to_numpy() > 0
        weights[found["at"].to_numpy()[some]] = (found["w"] / found["mass"]).to_numpy()[some]
        weights = weights.reshape(GATES, INPUTS)
    found = total(_outcomes(shared, weights, refined))
    flat, i = refined.ravel().copy(), found["at"].to_numpy()
    flat[i] = (found["w"].to_numpy() + 8 * flat[i]) / (found["mass"].to_numpy() + 8)
    return shared, weights, flat.reshape(256, LOGIT_STEPS)


class Scorer:
    """Scores texts; remembers 6-grams in a table of fixed size, the newest of those that share a place."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(1 << CACHE_BITS, np.uint64(1 << 63), np.uint64)
        self.values = np.zeros(1 << CACHE_BITS, np.float32)

    def log10(self, raw: list[bytes]) -> np.ndarray:
        g, size = ngrams(raw)
        out = np.empty(len(g))
        for at in range(0, len(g), 1 << 18):
            part = g[at:at + (1 << 18)]
            place = (part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)
            miss = self.keys[place] != part
            value = self.values[place].astype(np.float64)
            if miss.any():
                u, back = np.unique(part[miss], return_inverse=True)
                score = np.concatenate([self.model.log10(u[i:i + 16384]) for i in range(0, len(u), 16384)])
                value[miss] = score[back]
                home = (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)
                self.keys[home] = u
                self.values[home] = score
                # of two 6-grams for one place the last is in both arrays, as numpy assigns in order
            out[at:at + (1 << 18)] = value
        return np.add.reduceat(out, np.cumsum(size) - size)


def _lists(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each row its distinct keys and how often it has them."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
    ends = pa.array(np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32))
    times = np.diff(np.append(first, len(key)))
    return pa.ListArray.from_arrays(ends, pa.array(key[first], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def _score(tables, weights: np.ndarray, refined: np.ndarray, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, denominator = frequent.value
        scorer = Scorer(Model(None, None, None, weights, refined, *unpacked(tables, for_scoring=True)))
        for batch in chunks(batches, CHUNK):
            raw = [_lowered(t) for t in batch.column("text").to_pylist()]
            total = scorer.log10(raw)
            key, size = word_keys(raw)
            u, back = np.unique(key, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
            c = np.where(keys[at] == u, counts[at], -1)[back] if len(keys) else np.full(len(key), -1)
            starts, apart = np.cumsum(size) - size, c < 0
            base = np.add.reduceat(np.where(apart, 0.0, np.log10((c + 1 + apart) / denominator)), starts)
            rare, rare_n = _lists(np.repeat(np.arange(len(raw)), size)[apart], key[apart], len(raw))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array(size), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                pa.array(base), pa.array([len(r) for r in raw], pa.int64()), pa.array(total), rare, rare_n],
                ["doc_id", "row", "n_tokens", "n_known", "base", "n_bytes", "score", "rare", "rare_n"])
    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score every whole text with a model of those not ``held_out`` (a condition on doc_id; null counts as training).

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte); scores are log10
    probabilities of the text with A-Z lower-cased. A null or empty text is its end alone. Repeated rows are scored
    each; they also train each. Without training texts counts are zero and the mixer is as it starts. Other columns are left behind.
    """
    rows = texts(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    counts = corpus_counts(rows.filter(~F.col("held_out")))
    words = counts.filter(F.col("key") >= F.lit(WORD_FLAG))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = train(counts)  # tables, weights, adaptive map
    step = F.floor(F.log2("n") * 4).cast("int")
    sizes = sorted(words.groupBy(step.alias("s")).count().collect(), reverse=True)  # at most 256 steps
    least, held = None, 0
    for s, many in sizes:
        held += many
        if held > FREQUENT_WORDS:
            break
        least = s
    common = (words.filter(step >= least) if least is not None else words.limit(0)).toArrow()
    keys, values = common.column("key").to_numpy(), common.column("n").to_numpy()
    order = np.argsort(keys)
    denominator = n + v + 1
    frequent = docs.sparkSession.sparkContext.broadcast((keys[order], values[order], denominator))
    schema = ("doc_id long, row long, n_tokens long, n_known long, base double, n_bytes long, score double, "
              "rare array<long>, rare_n array<long>")
    scored = materialize(rows.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        _score(*model, frequent), schema))
    apart = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "row", F.col("r.rare").alias("key"), F.col("r.rare_n").alias("m"))
    known = words.select("key", F.col("n").alias("c"))
    rest = apart.join(known, "key", "left").groupBy("row").agg(
        F.sum(F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(denominator))).alias("rest"),
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rest_known"))
    return scored.drop("rare", "rare_n").join(rest, "row", "left").select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") / math.log10(2.0) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
