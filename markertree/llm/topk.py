"""Exact top-k inner products: vectors grouped by length, pruned by local cosine thresholds, then verified.

Rows are sorted by length and cut into groups of like length; a group is one task, with the queries brought to it in packed
blocks. In a group, buckets of like length are visited from the longest. A query's k-th score so far, over its own length
and the bucket's longest, is the local cosine threshold: above one the bucket is skipped; when high, rows must lie in a
feasible interval on the query's largest coordinates; when low, rows are cut by length alone. What is left is multiplied out
in whole numbers, so results are exact: in doubles where every product is below 2^53, else in Python integers for the rows that rounding
leaves in doubt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markertree.session import materialize

GROUP_ROWS = 16_384
"""Rows of one group: a task's memory, and how often queries are copied (once for each group)."""
BLOCK_ROWS = 1_024
"""Queries packed into one row."""
BUCKET_ROWS = 1_024
FOCUS = 4
"""Coordinates that coordinate pruning looks at."""
LARGEST = float(1 << 62)
"""Bound on scaled components."""
EXACT = float(1 << 52)
"""Products of lengths up to which doubles hold every partial sum exactly, with a bit to spare."""
COORDINATE_FROM = 0.5
"""Local threshold from which coordinate pruning is chosen over length pruning."""


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, x): floor(scale * component) of each vector. Null ids, null or empty vectors, and vectors with a null or
    non-finite component are left out, as are other columns. Scaled components are held within 2^62."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * scale)))).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows padded with zeros to ``dim`` components."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat[offsets[0]:offsets[-1]]
    return out


def _grouped(dim: int, kind: str):
    """Pack the rows of a partition, sorted by falling length, into groups; rows that repeat id and vector are dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        number, ids, rows, held, last = 0, [], [], 0, None

        def out() -> pa.RecordBatch:
            x = np.concatenate(rows)
            return pa.RecordBatch.from_arrays([
                pa.array([first + number]), pa.array([np.concatenate(ids).tobytes()]), pa.array([x.astype(kind).tobytes()]),
            ], ["part", "ids", "x"])

        for batch in batches:
            x, i = _matrix(batch.column("x"), dim), batch.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
            keep = np.ones(len(i), bool)
            keep[1:] = (i[1:] != i[:-1]) | (x[1:] != x[:-1]).any(axis=1)
            if last is not None and len(i):
                keep[0] = i[0] != last[0] or (x[0] != last[1]).any()
            last = (i[-1], x[-1]) if len(i) else last
            x, i = x[keep], i[keep]
            while len(i):
                take = min(len(i), GROUP_ROWS - held)
                ids.append(i[:take]), rows.append(x[:take])
                held, i, x = held + take, i[take:], x[take:]
                if held == GROUP_ROWS:
                    yield out()
                    number, ids, rows, held = number + 1, [], [], 0
        if held:
            yield out()
    return run


def _candidates(q: np.ndarray, q_len: float, unit: np.ndarray, lengths: np.ndarray, theta: float) -> np.ndarray:
    """Rows of one bucket, longest first, that may reach ``theta``; lengths and unit vectors in floats, with slack."""
    longest = lengths[0]
    if theta <= 0 or q_len == 0:
        return np.arange(len(lengths))
    local = theta / (q_len * longest) - 1e-9
    if local > 1:
        return np.empty(0, np.int64)
    upto = int(np.searchsorted(-lengths, -(theta / q_len) * (1 - 1e-12), "right"))  # length pruning
    if local < COORDINATE_FROM:
        return np.arange(upto)
    rows = np.arange(upto)
    side = np.sqrt(max(0.0, 1 - local * local))
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        c = q[f] / q_len
        reach = side * np.sqrt(max(0.0, 1 - c * c)) + 1e-9
        low = -1.0 if c < 0 and -c > local else c * local - reach
        high = 1.0 if c > 0 and c > local else c * local + reach
        value = unit[rows, f]
        rows = rows[(value >= low - 1e-9) & (value <= high + 1e-9)]
    return rows


def _search_wide(query_ids, queries, q_all, q_len, ids, whole, x, lengths, unit, k: int):
    """As ``search_group``, where products can pass the doubles: rows are chosen by rounded products and a bound on their error."""
    found: list[tuple[int, int, int]] = []
    loss = 4.0 * (x.shape[1] + 2) * np.finfo(np.float64).eps
    for n, q in enumerate(q_all):
        best: list[tuple[int, int]] = []  # negative score and id, in order
        q_whole = queries[n].astype(object)
        for at in range(0, len(ids), BUCKET_ROWS):
            bi, bl = ids[at:at + BUCKET_ROWS], lengths[at:at + BUCKET_ROWS]
            theta = float(-best[-1][0]) if len(best) == k else -np.inf
            error = loss * q_len[n] * bl[0]
            rows = _candidates(q, q_len[n], unit[at:at + BUCKET_ROWS], bl, theta - abs(theta) * 1e-9)
            rows = rows[bi[rows] != query_ids[n]]
            rough = x[at + rows] @ q
            least = theta - abs(theta) * 1e-12 - error
            if len(rows) > k:
                least = max(least, np.partition(rough, len(rows) - k)[len(rows) - k] - 2 * error)
            rows = rows[rough >= least]
            new = [(-int(whole[at + r].astype(object) @ q_whole), int(bi[r])) for r in rows]
            best = sorted(best + new)[:k]
        found += [(n, i, -s) for s, i in best]
    which, best_id, score = zip(*found) if found else ((), (), ())
    edge = np.iinfo(np.int64).max
    return (np.array(which, np.int64), np.array(best_id, np.int64), np.array([min(max(s, -edge), edge) for s in score], np.int64),
            np.array(score, np.float64))


def search_group(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Each query's k best rows of a group: (query index, id, score, score as a double), ties to smaller ids, its own id left out.

    Scores beyond 64 bits read as the largest (or smallest) of them; the double tells them apart.
    """
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, whole, lengths = ids[order], x[order], lengths[order]
    x = whole.astype(np.float64)
    unit = x / np.maximum(lengths, 1e-300)[:, None]
    q_all = queries.astype(np.float64)
    q_len = np.sqrt((q_all ** 2).sum(axis=1))
    if len(ids) and q_len.max(initial=0.0) * lengths[0] > EXACT:  # partial sums of a product are within the product of the lengths
        return _search_wide(query_ids, queries, q_all, q_len, ids, whole, x, lengths, unit, k)
    best_score = np.full((len(q_all), k), -np.inf)
    best_id = np.full((len(q_all), k), np.iinfo(np.int64).max)

    def keep(n: int, score: np.ndarray, found: np.ndarray) -> None:
        own = found != query_ids[n]
        score, found = np.concatenate([best_score[n], score[own]]), np.concatenate([best_id[n], found[own]])
        if len(score) > 4 * k:  # no row below the k-th score can stay
            least = np.partition(score, len(score) - k)[len(score) - k]
            score, found = score[score >= least], found[score >= least]
        top = np.lexsort((found, -score))[:k]
        best_score[n], best_id[n] = score[top], found[top]

    for at in range(0, len(ids), BUCKET_ROWS):
        bx, bi, bl, bu = (v[at:at + BUCKET_ROWS] for v in (x, ids, lengths, unit))
        if at == 0:  # nothing to prune by yet
            for n, score in enumerate(q_all @ bx.T):
                keep(n, score, bi)
            continue
        for n in range(len(q_all)):
            rows = _candidates(q_all[n], q_len[n], bu, bl, best_score[n, -1])
            if len(rows):
                score = bx[rows] @ q_all[n]
                good = score >= best_score[n, -1]
                if good.any():
                    keep(n, score[good], bi[rows[good]])
    which, col = np.nonzero(np.isfinite(best_score))
    return which, best_id[which, col], best_score[which, col].astype(np.int64), best_score[which, col]


def _search(dim: int, k: int, kind: str):
    def run(key, left, right):
        out = {"query_id": [], "vec_id": [], "score": [], "lead": []}
        for ids, x in zip(left.column("ids").to_pylist(), left.column("x").to_pylist()):
            ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x, kind).reshape(-1, dim)
            for qi, qx in zip(right.column("ids").to_pylist(), right.column("x").to_pylist()):
                qi, qx = np.frombuffer(qi, "<i8"), np.frombuffer(qx, kind).reshape(-1, dim)
                n, found, score, lead = search_group(qi, qx, ids, x, k)
                for name, value in zip(out, (qi[n], found, score, lead)):
                    out[name].append(value)
        return pa.table({name: pa.array(np.concatenate(v) if v else [], pa.float64() if name == "lead" else pa.int64())
                         for name, v in out.items()})
    return run


def _blocks(dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, i = _matrix(batch.column("x"), dim), batch.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(i), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([
                    pa.array([i[at:at + BLOCK_ROWS].tobytes()]), pa.array([x[at:at + BLOCK_ROWS].astype(kind).tobytes()])],
                    ["ids", "x"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector under ``is_query`` its k largest integer inner products.

    Every other vector is a candidate; ties go to the smaller vec_id; fewer candidates give fewer rows. Rows that repeat an
    id and vector count once. Vectors of different dimension compare as if padded with zeros. An empty table gives no rows.
    Scores beyond 64 bits read as the largest long and are ranked by their value as a double.
    """
    rows = materialize(quantized(vectors, scale))
    size, widest, n = rows.agg(F.max(F.size("x")), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))), F.count(F.lit(1))).first()
    dim, kind = size or 1, "<i4" if (widest or 0) < 1 << 31 else "<i8"
    length = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    parts = max(1, -(-n // GROUP_ROWS))
    packed = materialize(rows.withColumn("_length", -length).repartitionByRange(parts, "_length", "vec_id").sortWithinPartitions(
        "_length", "vec_id").select("vec_id", "x").mapInArrow(_grouped(dim, kind), "part long, ids binary, x binary"))
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "x"])
    blocks = asked.coalesce(max(1, parts // 8)).mapInArrow(_blocks(dim, kind), "ids binary, x binary")
    # a packed block goes once to each group of GROUP_ROWS rows
    sent = blocks.crossJoin(packed.select(F.col("part").alias("to")))
    found = packed.repartition(parts, "part").groupBy("part").cogroup(sent.groupBy("to")).applyInArrow(
        _search(dim, k, kind), "query_id long, vec_id long, score long, lead double")
    order = Window.partitionBy("query_id").orderBy(F.desc("lead"), F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("lead", "score")).alias("s")).select("query_id", "vec_id", "s.*")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
