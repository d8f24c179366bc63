"""Each operator against a plain version, on small rows with nulls, empty and long texts, repeats and clashing columns."""

import gzip
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markertree.llm import bpe, chat, lm, packing, quality, simhash, substring, topk, toxicity, warc

DOCS = "doc_id long, text string, score double, bits string, length int"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(70))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One\n two  THREE"), (4, "One\n two  THREE"), (None, "lost id")]
    rows += [(i, " ".join(word() for _ in range(r.randint(5, 90)))) for i in range(10, 40)]
    rows += [(50 + i, f"{word()} {word()} {passage} {word()}") for i in range(4)]
    rows += [(60, " ".join(word() for _ in range(6000))), (61, "x" * 3000 + "<|endoftext|> it's 12"), (62, rows[8][1])]
    return spark.createDataFrame([(i, t, 0.0, "b", 1) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe_equals_tiktoken_and_round_trips(docs):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path, pattern).ranks, special_tokens={})
    found = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    want = Counter((r.doc_id, tuple(plain.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found) == want


def test_simhash_equals_brute_force(docs):
    def bits(text):
        w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = docs.collect()
    found = Counter((r.doc_id, r.bits % (1 << 64)) for r in simhash.near_duplicates(docs).collect())
    assert found == Counter((r.doc_id, bits(r.text)) for r in rows)
    r = np.random.default_rng(1)
    own = r.integers(0, 1 << 63, 1500, dtype=np.uint64)
    own[700:] = own[:800] ^ (np.uint64(1) << r.integers(0, 63, 800).astype(np.uint64))
    pairs = {(int(a), int(b)) for i, j in simhash.close_pairs(own, own, 4, leaf=16) for a, b in zip(i, j)}
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= 4))}


def test_simhash_representatives_keep_null_and_repeated_ids(spark):
    r = random.Random(16)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(7)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[3]), (4, texts[4]),
            (None, texts[4]), (7, None), (7, texts[5]), (8, ""), (9, texts[6]), (9, texts[6])]
    df = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, bits string")
    found = simhash.representatives(df)
    assert found.columns == df.columns
    assert Counter((x.doc_id, x.text) for x in found.collect()) == Counter(
        [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (4, texts[4]), (7, None), (7, texts[5]), (9, texts[6])])


def test_simhash_shards_keep_links(spark):
    r = random.Random(2)
    values = [r.getrandbits(63) for _ in range(300)]
    values += [v ^ (1 << r.randrange(62)) ^ (1 << r.randrange(62)) for v in values[:200]]
    df = spark.createDataFrame([(v,) for v in values], "bits long")
    roots = {n: g for n, g in simhash.components(simhash.hamming_links(df, 4, shard_rows=32)).collect()}
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in zip(values[:200], values[300:]))
    assert len({roots.get(v, v) for v in values}) == 300


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8) * (1 + i % 3)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [rows[7], (400, None), (401, [1.0, float("nan")]), (402, [None] * 8)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, rank int")
    found = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    good = {i: np.floor(1024 * np.array(x)).astype(int) for i, x in rows[:360]}
    want = [(q, n + 1, i, s) for q in good if q % 50 == 0 for n, (s, i) in enumerate(
        sorted(((-int(good[q] @ good[i])), i) for i in good if i != q)[:5])]
    assert found == sorted((q, n, i, -s) for q, n, i, s in want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_pruned_search_is_exact():
    r = np.random.default_rng(4)
    x = (r.normal(size=(5000, 6)) * r.exponential(300, size=(5000, 1))).astype(np.int32)
    q = np.concatenate([x[:20], np.zeros((1, 6), np.int32)])
    which, ids, score, _ = topk.search_group(np.arange(-21, 0), q, np.arange(5000), x, 7)
    for n in range(21):
        s = x.astype(np.int64) @ q[n].astype(np.int64)
        top = np.lexsort((np.arange(5000), -s))[:7]
        assert ids[which == n].tolist() == top.tolist() and score[which == n].tolist() == s[top].tolist()


@pytest.mark.parametrize("size", [30_000.0, 3e6, 3e9])
def test_top_k_is_exact_for_large_components(spark, size):
    r = np.random.default_rng(6)
    vectors = (r.normal(size=(150, 16)) * size).tolist()
    vectors[40] = [c + 1 / 1024 for c in vectors[3]]  # all but equal, apart only in the last digits
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    whole = [[math.floor(c * 1024) for c in v] for v in vectors]
    edge = (1 << 63) - 1
    want = []
    for q in range(0, 150, 10):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(150) if i != q)[:5]
        want += [(q, n + 1, i, max(-edge, min(edge, -s))) for n, (s, i) in enumerate(scores)]
    assert sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()) == want


def test_top_k_takes_nulls_and_vectors_of_different_length(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0]), (None, [9.0]), (3, []), (4, [float("inf")]), (5, [0.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") <= 2, 3).collect())
    top = (1 << 63) - 1
    assert found == [(1, 1, 5, top), (1, 2, 2, 1 << 20), (2, 1, 1, 1 << 20), (2, 2, 5, 0)]


def test_packing_places_every_id_once(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.pack(packing.tokenize_pieces(docs, path, public_tokenizers.PATTERN)).collect()
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in found) == total
    for r in docs.filter("doc_id in (60, 61)").collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        for p in (p for p in found if p.doc_id == r.doc_id):
            part = np.array(ids[p.start:p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32
    by: dict = {}
    for p in found:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for slots in by.values():
        assert sum(n for _, n in slots) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(slots), sorted(slots)[1:])) and min(slots)[0] == 0


def test_packing_tokenizer_is_exact_and_bounded(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "CACHED_RUNS", 16)
    coder, plain = packing.PieceTokenizer(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    assert coder.split is packing.RUNS
    signs = ["a", "don't", "We'll,", "'re", "é", "ß!", "x_1", "12", "...", "—!", " ", "  ", "\n", "\n\n ", "\t", "\x1c", "\x1f", "\u00a0",
             "\u2028", "\u3000", "日本", "٣", "²", "🙂", "e\u0301", "<|endoftext|>", "\0"]
    r = random.Random(4)
    texts = ["", *("".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(1500)), " ".join(f"w{chr(97 + i % 26)}{i}" for i in range(500))]
    assert coder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(coder.known) <= 16 and len(coder.known.before) <= 16


def test_packing_plan_uses_counts():
    r = random.Random(1)
    for _ in range(100):
        counts = Counter(r.randint(1, 49) for _ in range(r.randint(0, 80)))
        used = Counter()
        for kind, n in packing.plan_packing(dict(counts), 50):
            assert sum(kind) <= 50
            used.update({s: c * n for s, c in Counter(kind).items()})
        assert used == counts


def test_quality_counts_equal_plain_ones(docs):
    model = quality.Model(np.zeros((4, 1 << quality.BITS), np.float32), 5.0)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.assess(docs, model).collect():
        t, w = text[r.doc_id], words(text[r.doc_id])
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and r.kept == (not r.base_failed)


def test_trie_walk_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(8)
    term = lambda: "".join(r.choice("abc") for _ in range(r.randint(3, 11)))
    terms = {term(): 1.0 for _ in range(40)}
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        w = term()
        near = [distance(w, t) for t in terms if distance(w, t) <= (toxicity.edits_allowed(t) if min(len(w), len(t)) >= 5 else 0)]
        found = trie.match(w)
        assert (found is None) == (not near) and (found is None or found[1] == min(near))


def test_toxicity_scores_every_text(spark, sf, docs):
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    model = toxicity.fit(table("documents"), table("labels"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    empty = toxicity.fit(docs, table("labels").limit(0))
    assert toxicity.score(docs, empty).filter("predicted = 1").count() == 0


def test_repeated_passages_are_found_and_cut(docs):
    passages = substring.duplicate_passages(docs).collect()
    found = {(r.doc_id, r.source_doc_id) for r in passages}
    assert {(51, 50), (52, 50), (53, 50)} <= found
    assert {r.doc_id for r in passages} <= {51, 52, 53, 62}
    left = substring.without_passages(docs, substring.duplicate_passages(docs))
    assert left.columns == docs.columns and left.count() == docs.count()
    assert all(len(words(r.text)) < 10 for r in left.filter("doc_id in (51, 52, 53)").collect())
    assert substring.duplicate_passages(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_are_not_cut_by_each_other(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(6)) for _ in range(n))
    passage = prose(70)
    rows = [(1, f"{prose(100)} {passage}"), (2, f"{prose(100)} {passage}"), (2, prose(300)), (3, f"{prose(20)} {passage}"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = substring.without_passages(df, substring.duplicate_passages(df)).collect()
    size = sorted((x.doc_id, len(words(x.text))) for x in left)
    assert len(left) == 5 and size[0] == (1, 170)
    assert (2, 300) in size and ((2, 100) in size or (2, 170) in size)
    assert (3, 0) in size and ((3, 20) in size or (3, 90) in size)


def test_lexicon_does_not_hang_on_the_order_of_copies(spark):
    clean, bad = "a calm walk along the quiet river bank today", "you grobnak idiot get away from the river bank"
    rows = [(i, f"{clean} number {i}", 0) for i in range(60)] + [(100 + i, f"{bad} number {i}", 1) for i in range(30)]
    rows += [(200, rows[70][1], 0), (201, rows[5][1], 1)]  # copies with another label
    frame = lambda x, parts: spark.createDataFrame(x, "doc_id long, text string, y int").repartition(parts)
    assert toxicity.lexicon(frame(rows, 1)) == toxicity.lexicon(frame(rows[::-1], 7))


def test_cut_words_keeps_the_rest():
    assert substring.cut_words(" a  bé\tc\nd ", [(1, 3)]) == " a  d "
    assert substring.cut_words("", [(0, 1)]) == ""


def test_language_model_base_is_exact(docs):
    rows = lm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    lower = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in docs.collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for r in docs.collect():
        if not out(r.doc_id):
            c.update(lower[r.doc_id])
    n, v = sum(c.values()), len(c)
    assert len(rows) == docs.count()
    for r in rows:
        w = lower[r.doc_id]
        want = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, out(r.doc_id))
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0


def test_warc_round_trip_and_pushed_filters(spark, tmp_path):
    rows = [(1, "u", "x" * 200), (2, "u\r\nv", "x" * 200), (2, "w", "x" * 200), (3, None, None), (4, "u", "é"), (5, "u", "é"), (None, "u", "x" * 200)]
    pages = spark.createDataFrame([(a, b, c, "n") for a, b, c in rows], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(warc.deduplicated(pages), path)
    back = warc.read_archives(spark, path).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in back) == [
        ("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("3", "response", None), ("4", "response", None),
        ("5", "response", None), ("None", "revisit", 1)]
    assert {r.page_id: r.payload for r in back if r.record_type == "response"} == {
        1: b"x" * 200, 3: b"", 4: "é".encode(), 5: "é".encode()}
    assert warc.read_archives(spark, path).filter("record_type = 'response' and page_id > 3").count() == 2


def test_warc_reads_long_headers(tmp_path):
    r = random.Random(15)
    raw = []
    for n in (10_000, 200_000):
        url = "http://a/" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
        record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: 7\r\n\r\n\r\n\r\nabc\r\n\r\n"
        raw.append((url, gzip.compress(record.encode())))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(x for _, x in raw))
    reader = warc.Reader(f"file://{tmp_path}", True)
    rows = [x for part in reader.partitions() for batch in reader.read(part) for x in batch.to_pylist()]
    assert [(x["target_uri"], x["payload"]) for x in rows] == [(url, b"abc") for url, _ in raw]


def test_chat_paths_of_a_tree(spark):
    rows = [(1, 1, None, "user", "a<&|"), (1, 2, 1, "assistant", "<|end|>"), (1, 3, 1, "assistant", "no"), (1, 4, 2, "user", None),
            (2, 1, 9, "user", "lone"), (3, 1, 2, "user", "cycle"), (3, 2, 1, "user", "cycle")]
    score = {(1, 2): 2.0, (1, 3): 1.0}
    df = spark.createDataFrame([(*r, score.get(r[:2])) for r in rows],
                               "conv_id long, msg_id long, parent_id long, role string, text string, score double").fillna("")
    done = chat.format_paths(chat.chosen_paths(df, 2)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    found = sorted((r.conv_id, r.path, [t.text for t in r.turns], r.loss) for r in done)
    assert found == [(1, 1, ["a<&|", "<|end|>", ""], "<|end|>"), (1, 2, ["a<&|", "no"], "no"), (2, 1, ["lone"], "")]


def random_words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_passages_with_an_edited_word_are_all_found(spark):
    r = random.Random(12)
    rows = []
    for n in range(50, 61):
        for at in (n // 2, n // 2 - 3, n // 2 + 2, n // 3):
            p = random_words(r, n)
            rows.append((len(rows), random_words(r, 20) + p + random_words(r, 20)))
            rows.append((len(rows), random_words(r, 30) + p[:at] + random_words(r, 1) + p[at + 1:] + random_words(r, 30)))
    shingles = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    want = {(b, b - 1) for b in range(1, len(rows), 2) if len(shingles[b] & shingles[b - 1]) >= 41}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert len(want) == len(rows) // 2
    assert {(x.doc_id, x.source_doc_id) for x in substring.duplicate_passages(docs).collect()} == want


def test_passages_that_repeat_a_later_document_are_found(spark):
    r = random.Random(14)
    rows, want = [], set()
    for n in (50, 60, 80):
        for _ in range(20):
            p = random_words(r, n)
            for step in range(4):
                if step:
                    k = step * n // 4
                    p = p[:k] + random_words(r, 1) + p[k + 1:]
                    want.add(len(rows))
                rows.append((len(rows), random_words(r, 9) + p + random_words(r, 9)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = substring.duplicate_passages(docs).collect()
    shingles = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    assert all(len(shingles[x.doc_id] & shingles[x.source_doc_id]) >= 41 for x in found)
    assert {x.doc_id for x in found} == want


def test_rows_are_cut_in_small_batches():
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(42)), "text": ["word " * 20_000] * 40 + [None, "as it is"], "_cuts": [[{"start_word": 0, "end_word": 19_999}]] * 41 + [None]})
    found = list(substring._cut(iter([batch])))
    assert max(b.num_rows for b in found) <= 12  # 1 MB of text, not the whole batch
    assert pa.Table.from_batches(found).to_pydict() == {"doc_id": list(range(42)), "text": ["word "] * 40 + [None, "as it is"]}


def test_packed_slots_score_as_the_tables_do():
    r = np.random.default_rng(3)
    zeros, ones = (r.integers(0, 300, lm.SLOTS).astype(np.uint16) for _ in range(2))
    g, _ = lm.ngrams([bytes(r.integers(97, 123, 3000, dtype=np.uint8).tolist()), b"", b"a"])
    checks = r.integers(0, 256, lm.SLOTS).astype(np.uint8)
    for j, _, at, check in lm.slots(g[:2000]):
        checks[at] = check
    refined = r.uniform(0.1, 0.9, (256, lm.LOGIT_STEPS))
    weights = r.normal(size=(lm.GATES, lm.INPUTS)) / 4
    model = lm.Model(zeros, ones, checks, weights, refined)
    plain = np.zeros(len(g))
    for j, bit, at, check in lm.slots(g):
        x, known = model.inputs(at, check)
        node = ((g & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - j)).astype(np.int64)
        p = model.refine(model.mixed(x, j * 49 + known), node)
        plain += np.log10(np.where(bit == 1, p, 1 - p))
    packed = lm.Model(None, None, None, weights, refined, lm.packed_slots(zeros, ones, checks))
    assert np.allclose(packed.log10(g), plain, rtol=1e-12, atol=0)


def test_words_of_texts_have_the_keys_of_their_bytes():
    raw = [b"", b" a\x0bb\x1fc ", b"\n\n", b"e" * 3000 + b" f", b"f a a", b"ab ba"]
    keys, size = lm.word_keys(raw)
    assert size.tolist() == [1, 3, 1, 3, 4, 3] and (keys[np.cumsum(size) - 1] == lm.WORD_FLAG).all()
    words_ = [w for r in raw for w in [*r.split(), b""]]
    assert len(set(zip(words_, keys.tolist()))) == len(set(words_)) == len(set(keys.tolist()))


def test_a_common_line_brings_no_texts_together(spark):
    r = random.Random(16)
    line = random_words(r, 16)
    rows = [(i, " ".join(random_words(r, 60) + line + random_words(r, 60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring.occurrences(docs, substring.LEAST_WORDS - substring.SHINGLE + 1, substring.SIMILARITY).count() == 0
