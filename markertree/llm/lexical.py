"""Ranked lexical search: Best Position Algorithm over impact lists, in shards of documents.

The queries travel in blocks of bounded size. For a block, one scan counts its terms in every whole text and stores them, a
row a document; corpus statistics are aggregates of that table. A second scan searches: a task cuts its rows into shards, sorts
each shard's postings into one impact list a term, and runs every query of the block over them. Lists are read in step from
the top; each document met is scored at once by direct access to its postings in all lists, and the positions found there
count as seen. A list's best position ends its unbroken run of seen positions, and the impacts just behind the best positions
bound every document not met. A query stops in a shard when that bound is strictly below its k-th score, which the task carries
from shard to shard. A task returns k rows a query, so nothing but these is shuffled and no term's list meets in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.llm.common import chunks
from markertree.session import materialize

BLOCK_TERMS = 1 << 18
"""Term occurrences in a block of queries (a longer query is a block of its own): bounds what a task is sent."""
SHARD_ROWS = 1 << 14
SHARD_POSTINGS = 1 << 20
"""A shard is closed at either number: a task's memory."""
FIRST_DEPTH = 16
"""Positions read from every list in the first step; each step reads twice as many as the one before."""

ASCII = [chr(c).lower() if chr(c).isalnum() else " " for c in range(128)]
FOLDED = bytes("".join(ASCII), "ascii") + bytes(range(128, 256))
"""Byte by byte: A-Z lower-cased, other ASCII letters, digits and all bytes of longer characters kept, the rest a space."""

COUNTED = "doc_id long, n long, terms array<int>, counts array<long>"


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(FOLDED).split()


def count_terms(vocabulary: dict[bytes, int]):
    """Documents with at least one term: number of terms, and the vocabulary's terms with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            keep, sizes, found, often, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = terms(text or b"")
                if not words:
                    continue
                keep.append(row), sizes.append(len(words))
                for word, count in Counter(words).items():
                    number = vocabulary.get(word)
                    if number is not None:
                        found.append(number), often.append(count)
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(keep, pa.int32())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(often, pa.int64()))], ["doc_id", "n", "terms", "counts"])
    return run


def term_weights(documents: int, holding: dict[int, int], size: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) for each term number."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(size)], np.int64)


class Shard:
    """Postings of some documents: by document, and as one list a term in order of falling impact."""

    def __init__(self, ids, null, n, sizes, term, count, weights: np.ndarray, documents: int, length: int):
        self.ids, self.null = ids, null
        norm = np.array([25 + (75 * int(v) * documents) // length for v in n], np.int64)  # Python integers: no overflow
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.term, self.doc = term, doc
        self.impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * norm[doc]))
        order = np.lexsort((doc, -self.impact, term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)  # of a document's posting in the lists
        self.place[order] = np.arange(len(order))
        self.first = np.concatenate([[0], np.cumsum(sizes)])  # a document's first posting
        self.numbers, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        self.seen = np.zeros(len(order), bool)

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``wanted``, start, end) of the terms that have a list here."""
        if not len(self.numbers):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.numbers, wanted), len(self.numbers) - 1)
        which = np.flatnonzero(self.numbers[at] == wanted)
        return which, self.bounds[at[which]], self.bounds[at[which] + 1]

    def postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``docs``, posting) of all postings of the documents."""
        size = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(np.arange(len(docs)), size), np.arange(total) + np.repeat(self.first[docs] - (ends - size), size)


class Best:
    """The k best rows of one query so far: score falling, then ids rising, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def floor(self) -> int:
        """The k-th score, 0 while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self.floor())
        if good.any():
            score, ids, null = (np.concatenate(p) for p in (
                (self.score, score[good]), (self.ids, ids[good]), (self.null, null[good])))
            top = np.lexsort((ids, null, -score))[:self.k]
            self.score, self.ids, self.null = score[top], ids[top], null[top]


def search_shard(shard: Shard, wanted: np.ndarray, repeats: np.ndarray, slot: np.ndarray, best: Best) -> int:
    """Run one query (term numbers ``wanted``, each ``repeats`` times) over a shard; returns the documents scored.

    ``slot`` is an all-zero scratch array over the vocabulary; it is zero again on return.
    """
    which, start, end = shard.lists(wanted)
    times = repeats[which]
    position = start.copy()  # best positions: all before are seen
    met = np.zeros(len(shard.ids), bool)
    slot[wanted] = repeats
    depth, step, scored, touched = 0, FIRST_DEPTH, 0, []
    while True:
        open_ = position < end
        bound = int((times[open_] * shard.list_impact[position[open_]]).sum())
        if bound == 0 or bound < best.floor():
            break
        reading = np.flatnonzero(start + depth < end)
        docs = np.unique(np.concatenate([
            shard.list_doc[start[i] + depth:min(end[i], start[i] + depth + step)] for i in reading]))
        depth, step = depth + step, step * 2
        docs = docs[~met[docs]]
        if len(docs):
            met[docs] = True
            scored += len(docs)
            row, posting = shard.postings(docs)  # direct access to all lists
            many = slot[shard.term[posting]]
            hit = many > 0
            row, posting, many = row[hit], posting[hit], many[hit]
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, row, many * shard.impact[posting])
            best.add(score, shard.ids[docs], shard.null[docs])
            places = shard.place[posting]
            shard.seen[places] = True
            touched.append(places)
        for i in np.flatnonzero(position < end):
            rest = shard.seen[position[i]:end[i]]
            stop = int(rest.argmin())
            position[i] += stop if not rest[stop] else len(rest)
    for places in touched:
        shard.seen[places] = False
    slot[wanted] = 0
    return scored


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, length: int) -> Iterator[Shard]:
    held, rows, postings = [], 0, 0

    def build() -> Shard:
        return Shard(*(np.concatenate([h[i] for h in held]) for i in range(6)), weights, documents, length)

    for batch in batches:
        ends = batch.column("terms").offsets.to_numpy()
        term, count = batch.column("terms").values.to_numpy(), batch.column("counts").values.to_numpy()
        ids = batch.column("doc_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids, n = ids.fill_null(0).to_numpy(), batch.column("n").to_numpy()
        at = 0
        while at < len(ids):
            to = int(np.searchsorted(ends, ends[at] + SHARD_POSTINGS - postings, "right")) - 1
            to = min(max(to, at + (rows == 0)), at + SHARD_ROWS - rows, len(ids))
            if to > at:
                part = slice(ends[at], ends[to])
                held.append((ids[at:to], null[at:to], n[at:to], np.diff(ends[at:to + 1]), term[part], count[part]))
                rows, postings = rows + to - at, postings + int(ends[to] - ends[at])
            if to < len(ids) or rows == SHARD_ROWS:
                yield build()
                held, rows, postings = [], 0, 0
            at = to
    if held:
        yield build()


def search(items: list[tuple[int, int | None, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int):
    """The k best documents of a task's rows for every query of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        slot = np.zeros(len(weights), np.int64)
        for shard in _shards(batches, weights, documents, length):
            for (_, _, wanted, repeats), found in zip(items, best):
                search_shard(shard, wanted, repeats, slot, found)
        for (query, item_id, _, _), found in zip(items, best):
            if len(found.score):
                many = len(found.score)
                yield pa.RecordBatch.from_arrays([
                    pa.array([query] * many, pa.int64()), pa.array([item_id] * many, pa.int64()),
                    pa.array(found.ids, pa.int64(), mask=found.null), pa.array(found.score, pa.int64())],
                    ["query", "item_id", "doc_id", "score"])
    return run


def blocks(queries: DataFrame) -> Iterator[list[tuple[int, int | None, Counter]]]:
    """Queries with their terms, in blocks of at most BLOCK_TERMS occurrences; rows that repeat id and text count once."""
    block, size = [], 0
    rows = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).distinct()
    for number, row in enumerate(rows.toLocalIterator()):
        words = terms((row["text"] or "").encode("utf-8", "surrogatepass"))
        if block and size + len(words) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        if words:
            block.append((number, row["item_id"], Counter(words)))
            size += len(words)
    if block:
        yield block


def rank_documents(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents above 0 of each query, equal scores by rising doc_id.

    Every row of ``documents`` (doc_id, text) is a document; rows repeating an id each count and null ids come last among equal
    scores. Null, empty and term-less texts are no documents and no queries. Rows of ``queries`` (item_id, text) that share an
    id but not the text are searched one by one. Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    schema = "query long, item_id long, doc_id long, score long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in blocks(queries):
        words = sorted({w for _, _, bag in block for w in bag})
        vocabulary = {w: i for i, w in enumerate(words)}
        counted = materialize(texts.mapInArrow(count_terms(vocabulary), COUNTED))
        total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        if not total["n"]:
            break
        holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most a block's terms
        weights = term_weights(total["n"], {r["term"]: r["count"] for r in holding}, len(words))
        items = []
        for number, item_id, bag in block:
            wanted = np.array(sorted(vocabulary[w] for w in bag), np.int64)
            items.append((number, item_id, wanted, np.array([bag[words[t]] for t in wanted], np.int64)))
        part = counted.mapInArrow(search(items, weights, total["n"], total["length"], k), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def rank_sql(k: int = 10) -> str:
    """The same search as one SQL query over ``documents`` and ``benchmark``, scoring every document."""
    upper = "".join(chr(c) for c in range(65, 91))
    found = rf"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH e AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {found} AS t FROM documents) WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM e),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM e) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
b AS (SELECT row_number() OVER () AS q, item_id, {found} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
i AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * len(t) * docs) // length) AS m FROM e, g),
s AS (
  SELECT q, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""
