"""Ranked search, whitening and token files against brute force, and on the edge cases."""

from __future__ import annotations

import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from heapq import heapify, heappop, heappush

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from corpora import EDGE_TEXTS, SF, documents, edge_docs  # noqa: E402
from talktrace.llm import catalog, lexical, tokenfile, tokens, whitening  # noqa: E402

# ---------------------------------------------------------------- op11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=50):
    rows = [(d, Counter(brute_terms(t))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    n_docs, length = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(brute_terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for doc, c, n in rows:
            m = 50 + 50 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def frame_of(spark, rows, names, extra=()):
    columns = {n: pa.array([r[i] for r in rows], pa.string() if n == "text" else pa.int64()) for i, n in enumerate(names)}
    return spark.createDataFrame(pa.table(columns | {e: pa.array(["clash"] * len(rows), pa.string()) for e in extra}))


ITEMS = [(1, "The quick fox of words"), (2, None), (3, ""), (None, "naïve 東京 license w17 w18"), (4, "row row mail"), (4, "card"), (5, "absent"), (1, "The quick fox of words")]


@pytest.mark.parametrize("block_terms,bits", [(200_000, 64), (3, 64), (200_000, 2)])
def test_search_against_brute_force(spark, block_terms, bits):
    draw = random.Random(9)
    copies = [(100 + i, draw.choice(["fox fox words of the", "the quick", "card mail row", "words"]), "en", "a") for i in range(300)]
    rows = EDGE_TEXTS + copies + [(None, "words", "en", "a")] * 3 + [(7, "word fox", "en", "a"), (7, "word fox", "en", "b")]
    docs = edge_docs(spark, rows, extra=("terms", "tfs", "n", "m", "h", "twin", "first"))
    items = frame_of(spark, ITEMS, ("item_id", "text"), extra=("doc_id", "term", "block"))
    got = Counter(map(tuple, lexical.search(docs, items, 5, block_terms, bits).collect()))
    assert got == brute_search([r[:2] for r in rows], ITEMS, 5)


def test_search_on_the_tables(spark):
    expected = oracle.connect(SF)
    assert oracle.difference(expected, catalog.ORACLES["op11_lexical"], catalog.op11_lexical(spark, SF)) is None
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = Counter(map(tuple, catalog.op11_lexical(spark, SF).collect()))
    assert got == brute_search([r[:2] for r in documents()], items)


def test_search_of_empty_tables(spark):
    docs, items = edge_docs(spark), frame_of(spark, ITEMS, ("item_id", "text"))
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id IN (4, 5)"), items)):
        found = lexical.search(a, b)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_equal_bags_are_one_class(spark):
    rows = [(i, 50, [1, 2], [1, i % 2 + 1]) for i in range(40)] + [(None, 50, [1, 2], [1, 1]), (99, 51, [1, 2], [1, 1])]
    frame = spark.createDataFrame(rows, "doc_id long, m long, terms array<int>, tfs array<int>")
    for bits in (64, 1):
        classes, members = lexical.classes_of(frame, bits)
        sizes = {(r.h, r.twin): r.n for r in members.groupBy("h", "twin").count().withColumnRenamed("count", "n").collect()}
        found = {(r.m, tuple(r.tfs)): (r.first, sizes[r.h, r.twin]) for r in classes.collect()}
        assert found == {(50, (1, 1)): (0, 21), (50, (1, 2)): (1, 20), (51, (1, 1)): (99, 1)}


# ---------------------------------------------------------------- op12


def vectors_of(spark, rows, extra=()):
    columns = {"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}
    return spark.createDataFrame(pa.table(columns | {e: pa.array(["clash"] * len(rows), pa.string()) for e in extra}))


def check_whitening(rows, got, limit=32):
    able = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in able), default=0)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in able], dtype=object).reshape(len(able), width)
    n, total = len(able), x.sum(axis=0) if len(able) else []
    y = np.array([[float(Fraction(int(a) * n - int(s), n)) for a, s in zip(row, total)] for row in x]).reshape(n, width)
    v = y.T @ y / max(1, n)
    values, vectors = np.linalg.eigh(v) if width else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    rank = min(limit, int((values > 1e-10 * max(values, default=0)).sum()) if len(values) else 0)
    assert len(got) == n * rank
    assert {r.component for r in got} == set(range(1, rank + 1))
    deviations = Counter((i, n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))) for (i, _), row in zip(able, x))
    for c in range(1, rank + 1):
        own = [r for r in got if r.component == c]
        assert Counter((r.vec_id, r.n, r.deviation) for r in own) == deviations
        z = y @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        if all(abs(values[c - 1] - values[j]) > 1e-6 * values[0] for j in range(width) if j != c - 1):
            by_id = sorted(((i is None, i or 0), a) for (i, _), a in zip(able, z))
            mine = sorted(((r.vec_id is None, r.vec_id or 0), r.whitened) for r in own)
            if len({k for k, _ in by_id}) == len(by_id):
                a, b = np.array([p[1] for p in by_id]), np.array([p[1] for p in mine])
                assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert all(abs(r.explained - values[c - 1] / np.trace(v)) < 1e-8 for r in own)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-4 for r in got)


def test_whitening_of_given_embeddings(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    check_whitening(rows, catalog.op12_whitening(spark, SF).collect())


def test_whitening_edges(spark):
    draw = np.random.default_rng(3)
    odd = [(1, None), (2, [1.0, None, 2.0]), (3, [1.0, math.nan, 2.0]), (4, [math.inf, 0.0, 0.0]), (None, [0.5, -2.0, 7.0]), (6, []),
           (7, [3.0]), (8, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [9.0, -4.0, 0.25, 5.0]), (10, [1e3, -1e3, 3.0, 1.0])]
    flat = [(i, [*map(float, v), float(v[0] + v[1])]) for i, v in enumerate(draw.integers(-9, 9, (60, 5)))]  # one dimension depends on two
    wide = [(i, list(map(float, v))) for i, v in enumerate(draw.normal(size=(90, 48)) * np.geomspace(300, 0.3, 48))]
    for rows in (odd, flat, wide, wide[:7], [(1, [1.0, 2.0])] * 3, [(1, [1.0, 2.0])], [(1, None)]):
        frame = vectors_of(spark, rows, extra=("n", "component", "deviation"))
        got = whitening.whiten(frame).collect()
        if len({str(v) for _, v in rows}) == 1:
            assert got == []
        else:
            check_whitening(rows, got)
        assert whitening.whiten(frame.limit(0)).collect() == []


def test_factor_and_rotation():
    draw = np.random.default_rng(8)
    for width, rank in ((1, 1), (2, 2), (7, 3), (40, 40)):
        a = draw.normal(size=(width, rank)) * np.geomspace(300, 1, rank)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v[order][:, order]) and np.allclose(factor, np.tril(factor))
        rotated = whitening.one_sided_jacobi(factor)
        gram = rotated.T @ rotated
        scale = np.sqrt(np.outer(np.diag(gram), np.diag(gram)))
        assert (np.abs(gram - np.diag(np.diag(gram))) <= 1e-12 * scale).all()
        values, vectors = whitening.components_of(v, width)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:rank], rtol=1e-9, atol=1e-13 * values[0])
        assert np.allclose(v @ vectors, vectors * values, atol=1e-9 * values[0])


# ---------------------------------------------------------------- op13


def huffman_total(counts):
    heap, total = list(map(int, counts)), 0
    heapify(heap)
    while len(heap) > 1:
        both = heappop(heap) + heappop(heap)
        total += both
        heappush(heap, both)
    return total


def least_total(counts, limit):
    """Least bits of a code of at most `limit` bits, by trying all numbers of codes for each length."""
    counts, best = sorted(counts, reverse=True), None

    def extend(at, length, free, total):
        nonlocal best
        if at == len(counts):
            best = total if best is None else min(best, total)
        elif length <= limit and free:
            for own in range(min(free, len(counts) - at) + 1):
                extend(at + own, length + 1, 2 * (free - own), total + length * sum(counts[at : at + own]))

    extend(0, 1, 2, 0)
    return best


def test_code_lengths_are_least_and_limited():
    draw = random.Random(2)
    for _ in range(60):
        counts = np.array([draw.randint(1, draw.choice([3, 50, 5000])) for _ in range(draw.randint(2, 9))])
        limit = draw.randint(max(1, (len(counts) - 1).bit_length()), 7)
        lengths = tokenfile.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -lengths) <= 1
        assert int((lengths * counts).sum()) == least_total(counts.tolist(), limit)
    counts = np.array([max(1, int(1e9 / i**1.2)) for i in range(1, 3000)])
    assert int((tokenfile.code_lengths(counts, 40) * counts).sum()) == huffman_total(counts)
    with pytest.raises(ValueError):
        tokenfile.code_lengths(np.ones(5, np.int64), 2)
    assert tokenfile.code_lengths(np.array([4]), 16).tolist() == [1]


def test_codebook_round_trip():
    draw = np.random.default_rng(4)
    for number, size in ((1, 1), (1, 700), (2, 3), (40, 255), (40, 256), (40, 257), (5000, 40_000)):
        ids = np.sort(draw.choice(60_000, number, replace=False))
        stream = np.concatenate([ids, draw.choice(ids, size, p=(p := np.arange(1, number + 1.0) ** -2) / p.sum())])[-max(size, number):]
        known, counts = np.unique(stream, return_counts=True)
        book = tokenfile.Codebook(known, tokenfile.code_lengths(counts))
        codes = [f"{c:0{n}b}" for c, n in zip(tokenfile.canonical_codes(book.lengths), book.lengths)]
        assert not any(b.startswith(a) for a, b in zip(sorted(codes), sorted(codes)[1:]))
        data, checkpoints = book.encode(stream)
        by_id = dict(zip(known.tolist(), codes))
        bits = "".join(by_id[i] for i in stream.tolist())
        assert "".join(f"{b:08b}" for b in data)[: len(bits)] == bits and len(data) == -(-len(bits) // 8) + 4
        assert book.decode(data, checkpoints, len(stream)).tolist() == stream.tolist()
        half = len(checkpoints) // 2  # blocks are independent
        assert book.decode(data, checkpoints[half:], len(stream) - 256 * half).tolist() == stream[256 * half :].tolist()


def brute_files(rows):
    whole = Tokenizer.from_file(tokens.TOKENIZER)
    start, out = 0, []
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("edge", [False, True])
def test_token_files(spark, edge):
    rows = [r for r in EDGE_TEXTS if r[0] != 9] if edge else documents()
    docs = edge_docs(spark, rows, extra=("shard", "ids", "start", "at", "row"))
    got = tokenfile.round_trip(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_files(rows))


def test_token_files_hold_ids_and_have_a_layout(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 2_000)
    rows = documents()[:60]
    folder = str(tmp_path / "files")
    tokenfile.write(edge_docs(spark, rows), folder)
    whole = Tokenizer.from_file(tokens.TOKENIZER)
    for r in tokenfile.read_ids(spark, folder).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        assert r.ids == [*whole.encode(text, add_special_tokens=False).ids, 0] and r.n_tokens == len(r.ids)
    segments = spark.read.parquet(f"{folder}/segments").orderBy("start").collect()
    assert len(segments) > 3 and [d for s in segments for d in s.doc_ids] == sorted(r[0] for r in rows)
    assert [s.start for s in segments] == np.cumsum([0, *(sum(s.sizes) for s in segments)])[:-1].tolist()
    assert all(len(s.checkpoints) == -(-sum(s.sizes) // tokenfile.BLOCK) for s in segments)
    codes = spark.read.parquet(f"{folder}/codes").toPandas()
    assert codes["n"].sum() == sum(sum(s.sizes) for s in segments)
    assert 8 * sum(len(s.bits) for s in segments) < 16 * codes["n"].sum()


def test_token_files_of_nothing_and_of_one_id(spark):
    docs = edge_docs(spark)
    assert tokenfile.round_trip(docs.limit(0)).count() == 0
    rows = [(i, None, None, None) for i in range(700)] + [(None, "", None, None)] * 2
    got = tokenfile.round_trip(edge_docs(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_files(rows))
