"""SimHash near-duplicates: fingerprints, exact Hamming links through vantage-point trees, connected components.

Distinct fingerprints are dealt into the leaves of a shallow vantage-point tree made from a bounded sample of them.
A leaf is a shard; a fingerprint is owned by one shard and visits, as a query, every other shard that the triangle
bound cannot rule out. In a shard both sides descend a deeper tree with the same bound. Shards report spanning
forests, not pairs, so a group of n copies costs n links; components are then joined in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.llm.common import chunks, texts
from markertree.session import materialize

SEED = 42
SHARD_ROWS = 16_384
"""Fingerprints that a shard should own; sets the depth of the sharding tree, not its result."""
SAMPLE_ROWS = 8_192
"""Bound on the sample that places vantage points and radii."""


def shingle_hashes(text: str, width: int = 4) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of the text with A-Z lower-cased, in order, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    return np.array([h(joined[i:j], SEED) for i, j in zip(starts.tolist(), (ends[width - 1:] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set where over half of the hashes have it; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            prints = [fingerprint(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(np.array(prints, np.uint64).view(np.int64))], [*names, "bits"])
    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, bits): the 64-bit fingerprint as a signed long. A null or wordless text has fingerprint zero."""
    return texts(docs).mapInArrow(_fingerprint_batches(width), "doc_id long, bits long")


def _plan_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Vantage point and median radius of each inner node of a complete tree, in heap order.

    The vantage point of a node is a mixed function of its number, not a row: points far from all data split best.
    """
    nodes: list[tuple[int, int]] = []
    parts = [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            v = vantage(len(nodes))
            d = np.bitwise_count(part ^ np.uint64(v))
            radius = int(np.median(d)) if len(d) else 32
            nodes.append((v, radius))
            below += [part[d <= radius], part[d > radius]]
        parts = below
    return nodes


def vantage(n: int) -> int:
    return xxhash.xxh64_intdigest(b"vantage %d" % n, SEED)


def _route(nodes: list[tuple[int, int]], depth: int, reach: int):
    """Send each fingerprint to its own leaf, and as a query to each smaller leaf that its ball can meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.arange(len(bits))
            at = np.zeros(len(bits), np.int64)
            own = np.ones(len(bits), bool)
            for _ in range(depth):
                v = np.array([n[0] for n in nodes], np.uint64)[at]
                radius = np.array([n[1] for n in nodes], np.int64)[at]
                d = np.bitwise_count(bits[rows] ^ v).astype(np.int64)
                inside = d <= radius
                left, right = d <= radius + reach, d > radius - reach
                rows = np.concatenate([rows[left], rows[right]])
                own = np.concatenate([(own & inside)[left], (own & ~inside)[right]])
                at = np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
            home = np.empty(len(bits), np.int64)
            home[rows[own]] = at[own]
            keep = at <= home[rows]  # of two leaves that can meet, the smaller does the work
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[keep]), pa.array(bits[rows[keep]].view(np.int64)), pa.array(own[keep])], ["leaf", "bits", "own"])
    return run


class Forest:
    """Union-find over positions; the smallest position of a tree is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def flatten(self) -> None:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return
            self.up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union pairs; those already in one tree are passed over by array."""
        open_ = self.up[a] != self.up[b]
        if not open_.any():
            return
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
        self.flatten()


def close_pairs(own: np.ndarray, asked: np.ndarray, reach: int, leaf: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in own, in asked) of all pairs at most ``reach`` bits apart, block by block, by a vantage-point tree."""
    stack = [(np.arange(len(own)), np.arange(len(asked)), 0)]
    while stack:
        p, q, level = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > leaf and level < 48:
            v = np.uint64(vantage(1_000_003 + level))
            dp, dq = np.bitwise_count(own[p] ^ v).astype(np.int16), np.bitwise_count(asked[q] ^ v).astype(np.int16)
            radius = int(np.median(dp))
            if radius >= dp.max():
                radius -= 1
            near = dp <= radius
            stack.append((p[near], q[dq <= radius + reach], level + 1))
            stack.append((p[~near], q[dq > radius - reach], level + 1))
            continue
        for at in range(0, len(p), leaf):
            part = p[at:at + leaf]
            for to in range(0, len(q), 4096):
                far = np.bitwise_count(own[part][:, None] ^ asked[q[to:to + 4096]][None, :])
                i, j = np.nonzero(far <= reach)
                yield part[i], q[to + j]


def _link_shard(reach: int):
    def run(key, table):
        bits = np.unique(table.column("bits").to_numpy().view(np.uint64))
        own = np.unique(table.filter(table.column("own")).column("bits").to_numpy().view(np.uint64))
        forest = Forest(len(bits))
        place = np.searchsorted(bits, own)
        for i, j in close_pairs(own, bits, reach):
            forest.join(place[i], j)
        roots = forest.up
        linked = np.nonzero(roots != np.arange(len(bits)))[0]
        return pa.table({"a": bits[linked].view(np.int64), "b": bits[roots[linked]].view(np.int64)})
    return run


def hamming_links(prints: DataFrame, reach: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct values of ``bits`` that give the same components as all pairs within ``reach`` bits."""
    distinct = prints.select("bits").distinct()
    n = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / shard_rows)))
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    # hash order is a sample here: xxhash64 of the bits is even over any set of fingerprints
    sample = distinct.filter(F.pmod(F.xxhash64("bits"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = sample.collect() if depth else []
    nodes = _plan_tree(np.array([r[0] for r in rows], np.int64).view(np.uint64), depth)
    routed = distinct.mapInArrow(_route(nodes, depth, reach), "leaf long, bits long, own boolean")
    return routed.groupBy("leaf").applyInArrow(_link_shard(reach), "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every linked node with the smallest node reachable, by alternating star steps.

    Each round joins the smallest neighbour to the others, until nothing changes; rounds grow with the logarithm
    of the longest chain. A group's links never exceed its nodes, so hot groups shrink from round to round.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    last = None
    while True:
        # large star: each node hands its smallest neighbour (or itself) to its larger neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours all move to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.filter("u <> v").distinct())
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark


def near_duplicates(docs: DataFrame, width: int = 4, reach: int = 4) -> DataFrame:
    """(doc_id, bits, component_id) for every document; component_id is the smallest doc_id reachable over links.

    Equal fingerprints are linked; wordless texts share fingerprint zero. Null ids keep their row and count as larger
    than any id; repeated rows are kept. Columns other than doc_id and text are left behind.
    """
    prints = materialize(fingerprints(docs, width))
    roots = components(hamming_links(prints, reach))
    heads = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    classed = heads.join(roots, heads.bits == roots.node, "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_bits = classed.join(least, "root").select("bits", "component_id")
    return prints.join(by_bits, "bits").select("doc_id", "bits", "component_id")


def representatives(docs: DataFrame, width: int = 4, reach: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, that with the smallest doc_id (null ids last); columns as they are.

    Rows that share a doc_id, or have none, are told apart by their texts; of those in one group the text's hash decides.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = texts(docs).select("doc_id", digest.alias("_digest"), "text")
    prints = materialize(rows.mapInArrow(_fingerprint_batches(width), "doc_id long, _digest string, bits long"))
    roots = components(hamming_links(prints, reach))
    head = prints.groupBy("bits").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_digest")).alias("f"))
    first = head.join(roots, head.bits == roots.node, "left").groupBy(F.coalesce("root", "bits").alias("root")).agg(
        F.min("f").alias("f")).select(F.col("f.doc_id").alias("_kept_id"), F.col("f._digest").alias("_kept_digest"))
    return docs.withColumn("_digest", digest).join(
        first, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi").dropDuplicates(
        ["doc_id", "_digest"]).drop("_digest")
