"""Byte-level BPE with a segment tree of pair ranks.

Each piece of a text is a row of byte positions. A segment tree over the positions holds, in every node, the least
(rank, position) of the adjacent pairs below it, so the root names the leftmost pair of least rank. A merge changes
three leaves: the pair itself, the pair to its left and the one that the merged right half used to start; each is a
point update along one path to the root. Short pieces are worked on side by side, one array row each; long ones alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.llm.common import chunks, texts

NONE = np.int64(1) << 62
SIDE_BY_SIDE = 64
"""Pieces of at most so many bytes are merged in arrays, longer ones one at a time."""
DECODED_IDS = 1 << 19
CACHED_PIECES = 1 << 20
"""Pieces that a task remembers before it starts anew."""


class Vocabulary:
    """Ranks of a tiktoken file: token bytes to rank, and pair of ranks to the rank of its merge."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.shift = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        self.slots = np.full(1 << int(64 - self.shift), -1, np.int64)
        self.merged = np.full(len(self.slots), NONE, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(keys)
        while len(keys):  # linear probing: one key settles in each free slot, the others step on
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[free]
            done = self.slots[at] == keys
            self.merged[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) % len(self.slots)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or NONE."""
        key = left << 32 | right
        at = self._slot(key)
        found = self.slots[at]
        out = self.merged[at]
        out[found != key] = NONE
        open_ = np.nonzero((found != key) & (found != -1))[0]
        while len(open_):
            step = at[open_] = (at[open_] + 1) % len(self.slots)
            found = self.slots[step]
            hit = found == key[open_]
            out[open_[hit]] = self.merged[step[hit]]
            open_ = open_[~hit & (found != -1)]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def merge_rows(v: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of many short pieces, a segment tree in each array row."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    width = 1 << max(1, int(lengths.max() - 1).bit_length())
    raw = np.zeros((n, width), np.uint8)
    used = np.arange(width) < lengths[:, None]
    raw[used] = np.frombuffer(b"".join(pieces), np.uint8)
    # all arrays are flat; position p of piece i is i * width + p, node t of its tree is i * 2 * width + t
    ids = v.single[raw]
    rank = np.full((n, width), NONE, np.int64)
    rank[:, :-1] = v.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
    rank[:, :-1][~used[:, 1:]] = NONE
    tree = np.full((n, 2 * width), NONE, np.int64)
    tree[:, width:] = np.where(rank == NONE, NONE, rank * width + np.arange(width))
    levels = width.bit_length() - 1
    for level in range(levels - 1, -1, -1):
        low = 1 << level
        tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
    tree, ids, alive = tree.ravel(), ids.ravel(), used.ravel().copy()
    following = np.tile(np.arange(1, width + 1), n)
    before = np.tile(np.arange(-1, width - 1), n)

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        base, node = rows * (2 * width), at + width
        tree[base + node] = value
        for _ in range(levels):
            other = tree[base + (node ^ 1)]
            value = np.minimum(value, other)
            node = node >> 1
            tree[base + node] = value

    rows = np.nonzero(tree[1::2 * width] != NONE)[0]
    while len(rows):
        top = tree[rows * (2 * width) + 1]
        merged, at = top // width, top % width
        base, size = rows * width, lengths[rows]
        here = base + at
        gone = following[here]
        ids[here] = merged
        alive[base + gone] = False
        after = following[base + gone]
        following[here] = after
        inner = after < size
        before[(base + after)[inner]] = at[inner]
        put(rows, gone, np.full(len(rows), NONE))
        right = v.pair_ranks(merged, ids[base + np.minimum(after, width - 1)])
        put(rows, at, np.where(inner & (right != NONE), right * width + at, NONE))
        left = before[here]
        some = left >= 0
        r, left = rows[some], left[some]
        pair = v.pair_ranks(ids[r * width + left], merged[some])
        put(r, left, np.where(pair != NONE, pair * width + left, NONE))
        rows = rows[tree[rows * (2 * width) + 1] != NONE]
    kept = np.split(ids[alive], np.cumsum(alive.reshape(n, width).sum(axis=1))[:-1])
    return kept


def merge_long(v: Vocabulary, piece: bytes) -> np.ndarray:
    """Ids of one long piece, by the same tree in plain lists."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = int(NONE)
    ids = v.single[np.frombuffer(piece, np.uint8)].tolist()
    following, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    get = v.pairs.get

    def pair(i: int, j: int) -> int:
        rank = get(ids[i] << 32 | ids[j])
        return none if rank is None else rank * width + i

    tree = [none] * (2 * width)
    tree[width:width + n - 1] = [pair(i, i + 1) for i in range(n - 1)]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, value: int) -> None:
        node = at + width
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    while tree[1] != none:
        at, merged = tree[1] % width, tree[1] // width
        gone = following[at]
        ids[at], alive[gone] = merged, 0
        after = following[at] = following[gone]
        put(gone, none)
        if after < n:
            before[after] = at
            put(at, pair(at, after))
        else:
            put(at, none)
        if before[at] >= 0:
            put(before[at], pair(before[at], at))
    return np.array([x for x, a in zip(ids, alive) if a], np.int64)


class Encoder:
    """Encodes texts piece by piece and remembers the pieces it has merged."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def learn(self, pieces: set[str]) -> None:
        short: list[tuple[str, bytes]] = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.v.ranks.get(raw)
            if whole is not None:
                self.known[piece] = np.array([whole], "<i4").tobytes()
            elif len(raw) > SIDE_BY_SIDE:
                self.known[piece] = merge_long(self.v, raw).astype("<i4").tobytes()
            else:
                short.append((piece, raw))
        short.sort(key=lambda x: len(x[1]))  # rows of like length share an array
        for at in range(0, len(short), 8192):
            part = short[at:at + 8192]
            for (piece, _), ids in zip(part, merge_rows(self.v, [raw for _, raw in part])):
                self.known[piece] = ids.astype("<i4").tobytes()

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        split = self.v.split.findall
        pieces = [split(t) for t in batch]
        new = set().union(*pieces).difference(self.known) if pieces else set()
        if new:
            if len(self.known) + len(new) > CACHED_PIECES:
                self.known.clear()
                new = set().union(*pieces)
            self.learn(new)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, p)), "<i4") for p in pieces]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of whole texts: each match of ``pattern`` merged by the ranks of ``path``, no special tokens.

    A null or empty text has no ids. Repeated rows are kept; other columns are left behind.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path, pattern))
        for batch in chunks(batches, 1 << 21):
            ids = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of each row's ids; null ids give no bytes, an unknown id is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path, pattern).tokens.__getitem__
        for batch in batches:
            ids = batch.column("ids")
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
            at = 0
            while at < len(batch):  # about DECODED_IDS ids at once
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODED_IDS, "right")) - 1)
                part = batch.slice(at, to - at)
                raw = [b"".join(map(token, row.as_py() or ())) for row in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])
                at = to

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
