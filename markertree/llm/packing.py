"""Best-fit packing after Martello-Toth dominance reduction, planned on counts of lengths.

Lengths are whole numbers up to the capacity, so an instance is its histogram: at most ``capacity`` numbers, whatever the
corpus. The plan (which lengths share a sequence, and how many such sequences) is made on the histogram; documents then
take their places by rank within their length, in Spark, with ranks summed over salted parts of a length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from markertree.llm.common import chunks, texts
from markertree.session import materialize

CAPACITY = 2048
SALTS = 256
"""Parts into which the documents of one length are dealt to be ranked."""
CACHED_RUNS = 1 << 17
"""Runs that a generation of ``Ids`` holds."""
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""A splitting pattern whose matches never go on from other characters into white space, nor from letters into marks: texts
may be cut there without changing a match."""
SPACE, LETTERS, MARKS = r"[^\S\x1c-\x1f]", r"[A-Za-zÀ-ÖØ-öø-ÿ]", r"[ \n!-&(-/:-@\[-`{-~]"
"""The four separators that only ``re`` takes for white space belong to words; the apostrophe, which begins contractions, is no mark."""
RUNS = re.compile(rf"{SPACE}*{LETTERS}+(?={MARKS}|\Z)|{SPACE}*[\S\x1c-\x1f]+|{SPACE}+").findall
"""White space with the letters, or else the whole word, behind it."""


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


class Ids(dict):
    """Ids of the runs met so far. What is not met while a generation fills up is forgotten with the next."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.before.get(run) or self.encode(run)
        if len(self) >= CACHED_RUNS:
            self.before = self.copy()
            self.clear()
        self[run] = ids
        return ids


class PieceTokenizer:
    """A byte-level tokenizer run on the distinct runs of its texts, each once while it is remembered.

    Runs are those of ``RUNS`` for ``BYTE_LEVEL``, else the matches of the tokenizer's own splitting pattern.
    """

    def __init__(self, path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.letters, self.model = regex.compile(pattern).findall, byte_letters(), self.tokenizer.model
        first = self.tokenizer.pre_tokenizer
        plain = (pattern == BYTE_LEVEL and self.tokenizer.normalizer is None and isinstance(first, ByteLevel)
                 and first.use_regex and not first.add_prefix_space)
        self.split = RUNS if plain else self.pieces
        self.known = Ids(self._run_ids if plain else self._ids)

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run_ids(self, run: str) -> bytes:
        """The same without the tokenizer's own splitting, which costs more than a short run's merges."""
        pieces = (run,) if run[run[0] == " ":].isalpha() and run.isascii() else self.pieces(run)
        return array("I", [token.id for piece in pieces for token in self.model.tokenize(
            piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers; what the tokenizer gives for the whole text."""
        known = self.known.__getitem__
        return [self._ids(t) if any(s in t for s in self.special) else b"".join(map(known, self.split(t))) for t in batch]


@lru_cache(maxsize=4)
def _tokenizer(path: str, pattern: str) -> PieceTokenizer:
    return PieceTokenizer(path, pattern)


def tokenize_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0,
                    with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each whole text's ids, then ``end_id``, cut only if too long.

    A null or empty text is one piece that holds ``end_id``. Of a cut text, all pieces but the first are full. Repeated
    rows are documents of their own; other columns are left behind.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(path, pattern)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches):
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, ids in enumerate(coder.encode(batch.column("text").to_pylist())):
                ids += tail
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
                    if with_ids:
                        raw.append(np.frombuffer(ids[4 * a:4 * b], "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return texts(docs).mapInArrow(run, schema)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths that share it, how many such), all lengths used as often as ``counts`` says.

    From the longest length down: a document that nothing left fits beside is alone; one that can be filled exactly by
    one other, or beside whose largest fitting partner no third would fit in place of it, is fixed with that partner:
    any packing can be changed to hold that set without one more sequence (Martello and Toth's dominance of small
    sets). What no rule fixes is packed best-fit, longest first.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    sizes = sorted(left)
    plan: dict[tuple[int, ...], int] = defaultdict(int)

    def drop(s: int, c: int) -> None:
        left[s] -= c
        if not left[s]:
            del left[s]
            del sizes[bisect.bisect_left(sizes, s)]

    at = len(sizes) - 1
    while at >= 0:  # sizes above ``at`` were looked at and not fixed
        s = sizes[at]
        room, smallest = capacity - s, sizes[0]
        if smallest > room or (len(sizes) == 1 and left[s] == 1):
            c = left[s]
            plan[(s,)] += c
            drop(s, c)
        else:
            partner = sizes[bisect.bisect_right(sizes, room) - 1]
            second = next((x for x in sizes if x != smallest), smallest) if left[smallest] == 1 else smallest
            if partner == room or smallest + second > room:
                # exact fill, or at most one fits beside s: the largest that fits dominates
                c = left[s] // 2 if partner == s else min(left[s], left[partner])
                if c:
                    plan[(s, partner)] += c
                    drop(s, c)
                    drop(partner, c)
                else:
                    at -= 1
            else:
                at -= 1
        at = min(at, len(sizes) - 1)

    # best fit for the remainder: open sequences by the room they have, each kind with its count
    rooms: list[int] = []
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def put(kind: tuple[int, ...], room: int, c: int) -> None:
        if room not in open_:
            open_[room] = defaultdict(int)
            bisect.insort(rooms, room)
        open_[room][kind] += c

    for s in sorted(left, reverse=True):
        c = left[s]
        while c:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                if c >= each:
                    put((s,) * each, capacity - s * each, c // each)
                if c % each:
                    put((s,) * (c % each), capacity - s * (c % each), 1)
                break
            room = rooms[i]
            kind, have = next(iter(open_[room].items()))
            each = min(room // s, c)
            used = min(have, c // each)
            open_[room][kind] -= used
            if not open_[room][kind]:
                del open_[room][kind]
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            put(kind + (s,) * each, room - s * each, used)
            c -= used * each
    for kinds in open_.values():
        for kind, c in kinds.items():
            plan[kind] += c
    return [(kind, c) for kind, c in plan.items() if c]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: rank from which a run starts, its first sequence and offset; a run is one slot of one kind."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for kind, c in plan:
        offset = 0
        for s in kind:
            runs[s].append((used[s], sequence, offset))
            used[s] += c
            offset += s
        sequence += c
    return {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with (sequence_id, offset) for rows of ``length`` 1 to ``capacity``; gapless from offset 0."""
    stored = materialize(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")))
    parts = stored.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity * SALTS rows
    counts: dict[int, int] = defaultdict(int)
    ranked: dict[tuple[int, int], int] = {}
    for length, salt, n in sorted(parts):
        ranked[length, salt] = counts[length]
        counts[length] += n
    full = counts.pop(capacity, 0)
    plan = plan_packing(dict(counts), capacity) + ([((capacity,), full)] if full else [])
    broadcast = stored.sparkSession.sparkContext.broadcast((_places(plan), ranked))  # runs: one for each length of a kind

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, first = broadcast.value
        for f in frames:
            sequence, offset = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            for (length, salt), rows in f.groupby(["length", "_salt"]).indices.items():
                rank = f["_rank"].to_numpy()[rows] - 1 + first[length, salt]
                start, seq, off = places[length]
                run = np.searchsorted(start, rank, "right") - 1
                sequence[rows] = seq[run] + rank - start[run]
                offset[rows] = off[run]
            yield f.drop(columns=["_salt", "_rank"]).assign(sequence_id=sequence, offset=offset)

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = stored.withColumn("_rank", F.row_number().over(order))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInPandas(place, f"{fields}, sequence_id long, offset long")
