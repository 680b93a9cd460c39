"""The alignment of tokenizers, the exact search and the vector codes against brute force, with what tables may hold."""

import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from structcheck.llm import token_alignment, topk_search, vector_codes

FILES = [P.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
TEXTS = [
    "The quick brown fox, don't stop.", "The quick brown fox, don't stop.", "", None, "x", "  two  spaces \n\n and\ttabs ", "<|endoftext|> and <s> are text </s>", "naïve café 数据 😀 ﬁ", "a" * 3000, " " * 2500 + "b", "▁mark", "1 22 333 4444 55555",
    "the the the the fox fox", " odd lines\r\n", "l’été à l’université, déjà vu",
]


def brute_alignment(texts):
    a_tok, b_tok = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    a_tok.encode_special_tokens = True
    ranks, pieces = token_alignment.rank_bytes(FILES[1]), token_alignment.piece_bytes(b_tok)
    links, out = [], []
    for text in texts:
        given = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        if b"".join(ranks[i] for i in a) != given or b"".join(pieces[i] for i in b) != given:
            a = b = []

        def spans(ids, table):
            ends = list(itertools.accumulate(len(table[i]) for i in ids))
            return list(zip([0, *ends], ends))

        sa, sb = spans(a, ranks), spans(b, pieces)
        links.append([(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(sa[i][0], sb[j][0]) < min(sa[i][1], sb[j][1])])
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = ["|".join(",".join(str(x) for x, s in zip(ids, sp) if lo < s[1] <= hi) for ids, sp in ((a, sa), (b, sb))) for lo, hi in zip([0, *cuts], cuts)]
        out.append([len(a), len(b), len(cuts), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = collections.Counter(p for each in links for p in set(each))
    top = collections.defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(*row[:4], sum(count[p] == top[p[0]] for p in each), sum(count[p] for p in each), row[4]) for row, each in zip(out, links)]


@pytest.mark.parametrize("share", [1, 10**6])
def test_alignment(spark, monkeypatch, share):
    """With ids dealt by chunk as well as by id; small chunks, slices and buffers."""
    monkeypatch.setattr(token_alignment, "HOT_SHARE", 20 if share == 1 else 1)
    for name, value in (("CHUNK", 40), ("SLICE", 16), ("BUFFER", 24)):
        monkeypatch.setattr(token_alignment, name, value)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, CODE int, node string").repartition(3, "doc_id")
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.align(docs, *FILES).collect()}
    assert got == dict(enumerate(brute_alignment(TEXTS)))
    assert token_alignment.align(docs.limit(0), *FILES).collect() == []
    twice = docs.withColumn("doc_id", F.lit(None).cast("long")).filter("text = 'x'")
    assert [tuple(r)[:6] for r in token_alignment.align(twice.unionByName(twice), *FILES).collect()] == [(None, 1, 1, 1, 1, 1)] * 2
    assert token_alignment.align(docs.filter("text = ''"), *FILES).first()["groups_sha256"] == ""


def test_varints():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 2**62, 5])
    data, at = token_alignment.varints(x)
    assert (token_alignment.numbers(data) == x).all() and at[-1] == len(data)
    assert len(token_alignment.numbers(np.zeros(0, np.uint8))) == 0


VECTORS = "vec_id long, embedding array<float>, label int, V int, kind string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], VECTORS)


def sample(n, width, seed=0, scale=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32) * np.float32(scale)
    x[n // 3 : n // 2] = x[n // 3]  # a third or so are copies
    return [(int(i), [float(c) for c in v], int(rng.integers(4)) if i % 9 else None) for i, v in enumerate(x)]


ODD = [(900, None, 1), (901, [float("nan")] * 64, 1), (902, [None] * 64, 1), (903, [float("inf")] * 64, 2), (904, [], 2), (905, [0.5, 0.5], 2), (906, [0.0] * 64, 2), (None, [0.1] * 64, 2), (5, [0.2] * 64, None), (5, [0.2] * 64, None), (907, [3e38] * 64, 1)]


@pytest.mark.parametrize("block,slice_rows", [(8192, 2048), (50, 7)])
def test_topk(spark, block, slice_rows):
    rows = sample(400, 64) + ODD
    out = collections.defaultdict(list)
    for r in topk_search.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, block=block, slice_rows=slice_rows).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, np.floor(np.array(v, np.float64) * 64).astype(int), at) for at, (i, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e30 and len(v) == 64]
    for i, q, at in whole:
        if i is not None and i % 20 == 0:
            best = sorted(((-int(q @ v), j is None, j or 0) for j, v, other in whole if other != at))[:20]
            assert out[i] == [(n, None if gone else j, -s) for n, (s, gone, j) in enumerate(best, 1)]
    assert set(out) == {i for i, _, _ in whole if i is not None and i % 20 == 0}


def test_topk_of_few_large_and_no_rows(spark):
    few = vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 1.0], 0), (20, [1.0, 1.0], 0), (3, [1e7, 1e7], 0)])
    got = [tuple(r) for r in topk_search.search(few, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    big = 64 * 10**7
    assert got == [(0, 1, 3, 64 * 3 * big), (0, 2, 1, 64 * 64 * 3), (0, 3, 20, 64 * 64 * 3), (20, 1, 3, 64 * 2 * big), (20, 2, 0, 64 * 64 * 3), (20, 3, 1, 64 * 64 * 2)]
    assert topk_search.search(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert topk_search.search(few, F.lit(False)).collect() == []
    assert len(topk_search.search(few.limit(1), F.lit(True)).collect()) == 0


def test_an_index_stops_early_and_loses_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(3000, 64)) * 8).astype(np.int64)
    x[:40] = x[0]
    index = topk_search.ImpactIndex(x, np.arange(len(x)))
    met, exact = 0, index.exact
    seen = []
    index.exact = lambda q, docs: (seen.append(len(docs)), exact(q, docs))[1]
    for i in range(0, 3000, 60):
        docs, scores = index.top(x[i], 20, i)
        met += seen[-1]
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:20]
        assert [(-int(s), int(j)) for s, j in zip(scores, docs)] == want
    assert met < 0.6 * 50 * 3000  # the others are out by their bounds


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    books = [[v[p * w : (p + 1) * w] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = collections.defaultdict(list)
            for _, v, _ in kept:
                met[nearest(v[p * w : (p + 1) * w], books[p])[1]].append(v[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(c) for c in zip(*met[k])] if met[k] else e for k, e in enumerate(books[p])]
    out, of_label = [], collections.Counter()
    for i, v, label in kept:
        best = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        of_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, of_label[label], digest) for i, code, e, label in out), key=str)


@pytest.mark.parametrize("labels", [10**6, 0])
def test_vector_codes(spark, monkeypatch, labels):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", labels)
    rows = sample(300, 64, seed=2)
    got = vector_codes.encode(vectors(spark, rows + ODD[:4] + ODD[6:10]).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows + ODD[6:10])


def test_vector_codes_of_other_dimensions_few_and_no_rows(spark):
    rows = [(1, [0.5, 0.25, -0.1, 0.0], 1), (2, [0.5], 1), (3, [1e30, 0.0, 0.0, 0.0], 2), (4, [], 2)]
    got = {r["vec_id"]: tuple(r)[1:4] for r in vector_codes.encode(vectors(spark, rows), parts=2, entries=4).collect()}
    assert got == {1: ("0000", 0, 0), 2: (None, None, 0), 3: (None, None, None), 4: (None, None, None)}
    assert {r["code"] for r in vector_codes.encode(vectors(spark, rows), parts=3).collect()} == {None}
    assert vector_codes.encode(vectors(spark, []), parts=2).collect() == []


def test_annuli_break_ties_by_index():
    rng = np.random.default_rng(5)
    book = rng.integers(-3, 4, (64, 4))
    x = rng.integers(-5, 6, (500, 4))
    index, least = vector_codes.Annuli(book).nearest(x)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (least == d.min(1)).all()
