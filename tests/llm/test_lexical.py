"""Ranked search against scoring every document by the formula."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from markertree.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, score long, rank int, terms string, n long"


def bag(text):
    return Counter("".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or ""))


def plain(docs, items, k=10):
    bags = [(i, bag(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // length
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t, c in bag(text).items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    word = lambda: r.choice("ab") + r.choice(["é", "x", "Q9", "-", "ß"]) + str(int(r.paretovariate(0.7)) % 400)
    docs = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " .,\0~ "), (7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (None, None)]
    docs += [(600, " ".join(word() for _ in range(30_000))), (601, "x" * 100_000), (602, docs[3][1].upper()), (603, docs[3][1])]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 20)))) for i in range(12)]
    items += [(20, docs[7][1]), (20, docs[7][1]), (21, docs[3][1]), (22, None), (23, "?!"), (24, "unheard"), (None, docs[9][1]),
              (25, docs[5][1] + " " + docs[6][1]), (25, "other text aé1"), (26, " ".join([docs[8][1]] * 3))]
    return docs, items


def test_equals_scoring_everything(spark, rows):
    docs, items = rows
    table = spark.createDataFrame([(i, t, 1, 2, 3, "z", 4) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(t, i, 5, 6) for i, t in items], "text string, item_id long, doc_id long, score long")
    found = lexical.rank_documents(table, asked)
    assert Counter(tuple(f) for f in found.collect()) == plain(docs, items)


def test_empty_tables_give_no_rows(spark, rows):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.limit(0), asked.limit(0))):
        found = lexical.rank_documents(d, q)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def counted(docs, vocabulary):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs]})
    return list(lexical.count_terms(vocabulary)(iter([batch.slice(0, 150), batch.slice(150)])))


def test_small_shards_and_blocks_equal_large_ones(spark, rows, monkeypatch):
    docs, items = rows
    bags = [b for b in (bag(t) for _, t in docs) if b]
    words = sorted({w.encode() for b in bags for w in b})
    batches = counted(docs, {w: i for i, w in enumerate(words)})
    weights = lexical.term_weights(len(bags), {words.index(w.encode()): c for w, c in Counter(t for b in bags for t in b).items()}, len(words))
    asked = [(q, i, np.array(sorted(words.index(w.encode()) for w in bag(t) if w.encode() in words), np.int64)) for q, (i, t) in enumerate(items)]
    asked = [(q, i, w, np.array([bag(items[q][1])[words[t].decode()] for t in w], np.int64)) for q, i, w in asked]
    run = lexical.search(asked, weights, len(bags), sum(sum(b.values()) for b in bags), 10)
    once = [b.to_pydict() for b in run(iter(batches))]
    for shard_rows, postings in ((7, 1 << 20), (1 << 14, 40), (1, 1)):
        monkeypatch.setattr(lexical, "SHARD_ROWS", shard_rows)
        monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
        assert [b.to_pydict() for b in run(iter(batches))] == once
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 25)  # many blocks on the driver side
    table = spark.createDataFrame(docs[:60], "doc_id long, text string")
    found = lexical.rank_documents(table, spark.createDataFrame(items[:14], "item_id long, text string"))
    assert Counter(tuple(f) for f in found.collect()) == plain(docs[:60], items[:14])


def test_stops_before_the_lists_end():
    """With k documents that hold every term often, most of the lists are never read."""
    r = random.Random(2)
    docs = [(i, " ".join(r.choices("abcdefgh", k=r.randint(20, 60)))) for i in range(5000)]
    docs += [(9000 + i, " ".join("abcd" * 30)) for i in range(12)]
    vocabulary = {w.encode(): i for i, w in enumerate("abcdefgh")}
    batches = counted(docs, vocabulary)
    weights = np.full(8, 500, np.int64)
    shard = next(lexical._shards(iter(batches), weights, len(docs), sum(len(t.split()) for _, t in docs)))
    best, slot = lexical.Best(10), np.zeros(8, np.int64)
    scored = lexical.search_shard(shard, np.arange(4), np.ones(4, np.int64), slot, best)
    assert best.ids.tolist() == list(range(9000, 9010)) and scored < len(docs) / 4 and not slot.any() and not shard.seen.any()
