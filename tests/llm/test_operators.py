"""Each operator against a brute-force version on a given table, and on the edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpora import EDGE_TEXTS, SF, documents, edge_docs  # noqa: E402
from talktrace.llm import catalog, common, htmltext, langid, licenses, mixing, packing, pii, quality, simhash, substrings, tokens, topk  # noqa: E402
from talktrace.llm.common import connected_components, stored  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- op1


def brute_fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)].append(doc)
    return [(doc, f"{fp:016x}", min((d for d in smallest[find(i)] if d is not None), default=None)) for i, (doc, fp) in enumerate(rows)]


@pytest.mark.parametrize("edge", [False, True])
def test_simhash(spark, edge):
    rows = EDGE_TEXTS if edge else documents()
    rows = [r for r in rows if r[1] is None or len(r[1]) < 250_000]
    docs = edge_docs(spark, rows, extra=("fp", "fingerprint", "component_id", "node", "root"))
    got = simhash.near_duplicates(docs).collect()
    expected = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    assert Counter(map(tuple, got)) == Counter(expected)


def test_simhash_links_chain_and_radius(spark):
    base = 0x0F0F_1234_5678_9ABC
    chain = [base, base ^ 0b11, base ^ 0b1111, base ^ 0b111111, base ^ (0b111 << 40)]
    frame = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in chain], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(frame)).collect()}
    assert len({roots[f] for f in chain[:4]}) == 1 and chain[4] not in roots
    with pytest.raises(ValueError):
        simhash.links(frame, 3)


def test_keep_first_keeps_one_row_of_each_group(spark):
    kept = simhash.keep_first(edge_docs(spark, [r for r in EDGE_TEXTS if r[0] != 9])).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and 1 in ids and not {2, 5, 6} & set(ids) and 4 in ids and None in ids


def test_keep_first_keeps_every_component(spark):
    texts = [" ".join(f"{word}{i}" for word in ("one", "two", "three", "four", "five")) for i in range(60)]
    rows = [(None, t, "en", "a") for t in texts[:20]] + [(None, t, "en", "b") for t in texts[:10]]  # no id, some twice
    rows += [(5, t, "en", "a") for t in texts[20:30]] + [(5, t, "en", "b") for t in texts[25:30]]  # one id, many texts
    rows += [(i, t, "en", "a") for i, t in enumerate(texts[30:], 100)] + [(None, t, "en", "a") for t in texts[30:35]]
    rows += [(7, t, "en", "a") for t in texts[35:40]]  # one id that is the smallest of many components
    kept = simhash.keep_first(edge_docs(spark, rows, extra=("fp", "root", "row", "first"))).collect()
    least = {}
    for doc, text, _, source in rows:
        least[text] = min(least.get(text, (True, 0, "z")), (doc is None, doc or 0, source))
    assert len({brute_fingerprint(t) for t in texts}) == len({c for _, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in enumerate(texts)])}) == 60
    assert Counter((r.text, (r.doc_id is None, r.doc_id or 0, r.source)) for r in kept) == Counter(least.items())


def test_keep_first_fingerprints_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(simhash, "stored", lambda frame: written.append(frame) or stored(frame))
    final = simhash.keep_first(edge_docs(spark, [r for r in EDGE_TEXTS if r[0] != 9]))
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (*written, final)]
    assert sum(len(re.findall(r"ArrowEvalPython \[", p.split("== Initial Plan ==")[-1])) for p in plans) == 1
    assert "ArrowEvalPython" in plans[0]


def test_components_of_path_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}


# ---------------------------------------------------------------- op2


def test_main_text_of_given_pages(spark):
    import html

    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in catalog.op2_main_text(spark, SF).collect()}
    assert len(got) == len(pages)
    for page_id, url, source in pages:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page_id].text == "\n".join(b for b in blocks if b)
        assert got[page_id].url == url and got[page_id].n_chars == len(got[page_id].text)


def test_main_text_edges(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    deep = "<div>" * 5_000 + "<p>" + "deep " * 40 + "</p>" + "</div>" * 5_000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain  text"), (4, "u", long), (5, "u", deep), (5, "u", deep), (None, "u", "<p>a<p>b"),
            (6, "u", "<article><h1>T</h1><p>One &lt;two&gt;</p><aside><p>skip</p></aside><form><p>mail</p></form><p>End.</p></article><div class='comments'><p>me too</p></div>"),
            (7, "u", "<script>if (a<b) x('</p>')</script><style>p{}</style><article><p>Only\n this</p></article><!-- no -->")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = defaultdict(list)
    for r in htmltext.extract(frame).collect():
        got[r.page_id].append(r.text)
    assert got[1] == [""] and got[2] == [""] and got[3] == ["plain text"]
    assert got[4] == ["\n".join(["word & word"] * 20_000)] and got[5] == ["deep " * 39 + "deep"] * 2 and got[None] == ["a\nb"]
    assert got[6] == ["T\nOne <two>\nEnd."] and got[7] == ["Only this"]
    assert htmltext.extract(frame.limit(0)).count() == 0


def test_main_text_without_articles_or_known_names():
    words = "Officials confirmed the ferry timetable would change next month after residents along the shore complained".split()

    def prose(n, k=0):
        return " ".join(words[(k + 7 * i + i // 5) % len(words)] for i in range(n)) + "."

    blocks = [prose(6), prose(60, 1), prose(70, 2), prose(45, 3)]
    article = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    frames = ['<div class="inhalt">{}</div>', "<div>{}</div>", "<main>{}</main>", '<div class="cuerpo"><div class="texto">{}</div></div>', "<table><tr><td>{}</td></tr></table>"]
    before = f'<div id="cc-window"><p>{prose(22, 4)}</p><button>OK</button></div><div class="kopf"><a href="/">Start</a> <a href="/x">Sport</a></div>'
    after = (
        f'<div class="kommentare"><div class="k"><b>Ute</b><p>{prose(12, 3)}</p></div><div class="k"><b>Jan</b><p>{prose(14, 5)}</p></div></div>'
        f'<div class="rechts"><h4>{prose(2)}</h4><ul><li><a href="/a">{prose(4)}</a></li></ul></div><div><p>{prose(12, 7)}</p></div>'
    )
    sections = f'<div class="z"><section><h1>{prose(5)}</h1><p>{prose(60, 1)}</p></section><section><h2>{prose(3, 2)}</h2><p>{prose(40, 4)}</p></section></div>'
    model = htmltext.train()
    for frame in frames:
        assert htmltext.main_text(f"<html><body>{before}{frame.format(article)}{after}</body></html>", model) == "\n".join(blocks)
    assert htmltext.main_text(f"<html><body>{sections}</body></html>", model) == "\n".join((prose(5), prose(60, 1), prose(3, 2), prose(40, 4)))
    assert htmltext.main_text(f"<html><body>{article}</body></html>", model) == "\n".join(blocks)


def test_marginals_match_enumeration():
    page = htmltext.parse("<div class=ad><p>some words here</p></div><article><h1>T</h1><p>x <a href=y>z</a></p></article>")
    model = htmltext.train()
    nodes = page.nodes
    total, yes = 0.0, np.zeros(len(nodes))
    for bits in range(2 ** (len(nodes) - 1)):
        state = [1] + [bits >> i & 1 for i in range(len(nodes) - 1)]
        energy = 0.0
        for i, node in enumerate(nodes[1:], 1):
            energy += state[i] * sum(model.own.get(f, 0.0) for f in htmltext.features(node))
            energy += model.edges.get(htmltext._kind(node.tag), model.default)[state[node.parent]][state[i]]
        total += np.exp(energy)
        yes += np.exp(energy) * np.array(state)
    assert np.allclose(model.marginals(page), yes / total, atol=1e-9)


# ---------------------------------------------------------------- op3


def test_language_accuracy_on_held_out(spark):
    rows = {r.doc_id: r for r in catalog.op3_language(spark, "/root/testdata/sf0.01").collect()}
    docs = documents("/root/testdata/sf0.01")
    assert len(rows) == len(docs)
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in docs)
    held = [(lang, rows[d].lang_pred) for d, _, lang, _ in docs if rows[d].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edges(spark):
    docs = edge_docs(spark, extra=("lang_pred", "score", "held_out"))
    got = defaultdict(list)
    for r in langid.identify(docs).collect():
        got[r.doc_id].append(r)
    assert len(got[11]) == 2 and not got[None][0].held_out
    for doc in (4, 5, 6, 12):
        assert got[doc][0].lang_pred == "und" and got[doc][0].score == 0
    assert got[8][0].lang_pred in ("en", "fr")
    assert langid.identify(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert {1, 2, 3, 8, 10} <= kept and not {4, 5, 6, 12} & kept
    assert 7 not in kept  # its one word has no known n-gram in any language
    unlabeled = edge_docs(spark, [(d, t, None, s) for d, t, _, s in EDGE_TEXTS])
    assert {r.lang_pred for r in langid.identify(unlabeled).collect()} == {"und"}
    assert langid.keep_identified(unlabeled).count() == 10


def test_language_stage_rejects_what_is_in_no_language(spark):
    draw = random.Random(4)
    rows = [r for r in documents() if r[1]]
    strange = [(10_000_000 + i, " ".join("".join(draw.choices("бгджзклмнпрст", k=7)) for _ in range(40)), None, "x") for i in range(20)]
    jumbled = [(20_000_000 + i, " ".join("".join(draw.choices("qxzjkvwy", k=8)) for _ in range(60)), None, "x") for i in range(20)]
    docs = edge_docs(spark, rows + strange + jumbled, extra=("share", "n"))
    kept = Counter(r.doc_id for r in langid.keep_identified(docs).collect())
    assert not [d for d in kept if d >= 10_000_000]
    lost = [r for r in rows if any(map(str.isalpha, r[1])) and not kept[r[0]]]
    assert len(lost) <= 0.01 * len(rows), [r[1][:80] for r in lost]
    assert max(kept.values()) == 1


def test_languages_are_learned_from_all_documents(spark):
    """Filters and threshold used to come from about 2,000 documents of a language."""
    rare = [f"q{a}{b}z" for a in "abcdef" for b in "ghijk"]
    rows = [(i, " ".join([f"{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 3} {'uvw'[i % 3] * 4}"] * 8)
             + (" " + " ".join(rare) if i % 600 == 5 else "") + f" {chr(0x4E00 + i)}" * (i % 1777), "x") for i in range(4900)]
    labeled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(labeled)
    grams = np.concatenate([langid.ngrams(w) for w in rare])
    assert filters.contained(grams)[0] == len(grams)
    shares = sorted(s for n, s in (langid.evidence(filters, t) for _, t, _ in rows) if n >= langid.LONG_ENOUGH)
    assert langid.least_evidence(labeled, filters) == 0.5 * shares[-(-len(shares) // 1000) - 1]


def test_ngrams_are_counted_in_parts(monkeypatch):
    counts, texts = langid._Counts(), ["abc abd", "", "abc", "x abc"]
    monkeypatch.setattr(langid, "_HELD", 4)
    for text in texts:
        counts.add("x", langid.ngrams(text))
    assert counts.full()
    (frame,) = counts.drain()
    whole = Counter(c for text in texts for c in langid.ngrams(text).view(np.int64).tolist())
    assert dict(zip(frame["code"], frame["n"])) == whole and not list(counts.drain())


def test_ngrams_and_filters_against_sets():
    text = "Hello wörld, abc de x1y. The end"
    folded = "".join(c.lower() if c.isalpha() else " " for c in f" {text} ")
    expected = Counter(folded[i : i + n] for n in (3, 4) for i in range(len(folded) - n + 1) if folded[i + 1 : i + n - 1].isalpha())
    counts = Counter(langid.ngrams(text).tolist())
    assert sorted(counts.values()) == sorted(expected.values())
    names = [f"l{i}" for i in range(11)]  # more than one byte of languages
    table = np.zeros((langid.SLOTS, 2), np.uint8)
    grams = {i: langid.ngrams(f"alpha{'abcdefghijk'[i] * 3} beta") for i in range(11)}
    for i, codes in grams.items():
        for h in range(langid.HASHES):
            np.bitwise_or.at(table, (langid.slots(codes, h), np.full(len(codes), i // 8)), np.uint8(1 << i % 8))
    filters = langid.LanguageFilters(names, table)
    for i, codes in grams.items():
        assert filters.contained(codes)[i] == len(codes) and filters.predict(f"alpha{'abcdefghijk'[i] * 3}")[0] == names[i]


# ---------------------------------------------------------------- op4


def brute_top(rows, k=20):
    able = []
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            able.append((vec_id, tuple(int(np.floor(64 * float(x))) for x in v)))
    out = []
    for q, a in dict.fromkeys(able):  # a query that is repeated is one
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in able if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return Counter(out)


def test_top_k_of_given_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    assert Counter(map(tuple, catalog.op4_top_k(spark, SF).collect())) == brute_top(rows)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_k_with_pruning_ties_and_faults(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_CLASS", 40)
    monkeypatch.setattr(topk, "CHUNK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in scale * (groups[i % 12] + 0.05 * rng.normal(size=8)) * rng.lognormal(0, 1)]) for i in range(500)]
    rows += [(500 + i, [scale] * 8) for i in range(100)]  # a common vector
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")]), (720, [float("inf")]), (None, [1.0] * 8), (740, []), (760, [1.0]), (760, [1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert Counter(map(tuple, topk.top_k(frame, k=7).collect())) == brute_top(rows, 7)


def test_vectors_go_to_the_blocks_that_their_class_can_serve(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(n), None if i % 50 == 0 else float(f)) for i, (n, f) in enumerate(zip(rng.uniform(0, 9, 400), rng.uniform(-5, 90, 400)))]
    rows += [(1000 + i, 2.0, 8.0) for i in range(300)] + [(2000, 0.0, 0.0)]  # a hot need, a vector of zeros
    floored = topk.by_need(spark.createDataFrame(rows, "vec_id long, norm double, floor double"), 7).persist()
    got = floored.collect()
    assert {r.vec_id for r in got} == {r[0] for r in rows} and len(got) == len(rows)
    sizes, lengths = Counter(r.block for r in got), {0: 50.0, 3: 7.0, 5: 4.5, 6: 0.5, 8: 0.0}
    assert max(sizes.values()) <= 2 * len(rows) / 7
    ranges = {b: [(-np.inf if r.need is None else r.need) for r in got if r.block == b] for b in sizes}
    assert all(max(ranges[b]) <= min(ranges[b + 1]) for b in range(max(sizes)) if b in ranges and b + 1 in ranges)
    served = topk.blocks_served(floored, lengths)
    for c, most in lengths.items():
        able = {r.block for r in got if r.floor is None or most * r.norm >= r.floor - 1e-9}
        assert served[c] == max(able, default=-1) + 1
    assert served[8] < served[5] <= served[3] <= served[0] == 7
    vectors = spark.createDataFrame([(i, c) for i, c in enumerate([0, 3, 5, 8] * 3)], "vec_id long, class int")
    sent = Counter((r.vec_id, r.block) for r in topk._sent(vectors, served | {5: 0}).collect())
    assert sent == Counter((i, b) for i, c in enumerate([0, 3, 5, 8] * 3) if c != 5 for b in range(served[c]))


def test_top_k_ranks_repeated_rows_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 5.0])] + [(3, [3.0, 0.0])] * 9 + [(20, [1.0, 1.0])] * 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 4, 10, 30):
        assert Counter(map(tuple, topk.top_k(frame, k=k).collect())) == brute_top(rows, k)


def test_long_texts_take_linear_time():
    def seconds(act, text):
        start = time.process_time()
        act(text)
        return time.process_time() - start

    model = pii.BoostedTrees()
    model.trees, model.probability = [None], lambda x: np.zeros(len(x))
    for act, unit in ((licenses.scan, "under the mit license "), (lambda t: pii.scan(t, model), "+1 (368) 555-0098 call. ")):
        act(unit * 10)
        short, long = unit * 8_000, unit * 32_000
        assert seconds(act, long) < 12 * max(0.05, min(seconds(act, short) for _ in range(2)))
    for start, middle, end in (("<i>", "", "<p>x"), ("<div>", "x", "</div>"), ("<li><td>", "", "</b></td>")):
        short, long = (start * n + middle + end * n for n in (4_000, 16_000))
        assert seconds(htmltext.parse, long) < 12 * max(0.05, min(seconds(htmltext.parse, short) for _ in range(2)))


def test_pages_cannot_label_themselves():
    source = '<div data-main="1">x</div>'
    assert htmltext.parse(source).nodes[1].label is None and htmltext.parse(source, marked=True).nodes[1].label is True


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.top_k(frame).collect())) == [(0, 1, 1, -4096)]
    assert topk.top_k(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- op5


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (budget - sum(2 * sizes[s] for s in full)) / rest if rest else 0
        over = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("edge", [False, True])
def test_mixing(spark, edge):
    rows = EDGE_TEXTS if edge else documents("/root/testdata/sf0.01")
    docs = edge_docs(spark, rows, extra=("size", "target", "block", "shards", "of", "no"))
    got = mixing.allocate(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.allocate(docs.repartition(5)).collect()))
    size = {(d, t): len(WORD.findall(t or "")) for d, t, *_ in rows}
    sizes, source = Counter(), {}
    for d, t, _, s in rows:
        sizes[s] += size[d, t]
        source[d] = s
    targets, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] in {n for (d, _), n in size.items() if d == r.doc_id} and len(r.shards) <= 2
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
        taken[source[r.doc_id]] += r["size"] * len(r.shards)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(15, (max(n for (d, _), n in size.items() if source[d] == s) if edge else 0.002 * target))


def test_mixture_rows_and_shards(spark):
    docs = edge_docs(spark, documents())
    allocated = {r.doc_id: sorted(r.shards) for r in mixing.allocate(docs, shards=8).collect()}
    mixed = defaultdict(list)
    for r in mixing.mix(docs, shards=8).select("row.doc_id", "shard").collect():
        mixed[r.doc_id].append(r.shard)
    assert {d: sorted(s) for d, s in mixed.items()} == {d: s for d, s in allocated.items() if s}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.allocate(docs.limit(0)).count() == 0


def test_shards_and_blocks_grow_with_the_words(spark):
    docs = edge_docs(spark, documents())
    words = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    for shard_words in (words // 3, words // 90):
        sized = mixing._sized(docs)
        drawn, blocks, shards = mixing.draws(sized, shard_words=shard_words)
        target = sum(r.target for r in drawn.select("source", "target").distinct().collect())
        assert shards == -(-int(target) // shard_words) and blocks == max(mixing.BLOCKS, 16 * shards)
        mixed = mixing.mix(docs, shard_words=shard_words)
        assert mixed.rdd.getNumPartitions() == shards
        parts = mixed.select("shard", F.spark_partition_id().alias("part")).distinct().collect()
        assert len({r.shard for r in parts}) == len(parts) and all(r.shard == r.part for r in parts)
        allocated = mixing.allocate(docs, shard_words=shard_words)
        assert mixed.count() == allocated.select(F.sum(F.size("shards"))).first()[0]


def test_draws_come_near_their_target():
    rng = np.random.default_rng(4)
    for n, target in ((1, 5.0), (40, 900.0), (3000, 77_777.5), (3000, 250_000.0)):
        words = rng.integers(0, 100, n)
        drawn = mixing._draw(pd.DataFrame({"source": "a", "block": range(n), "words": words, "target": target}))
        taken, most = int((words * drawn["copies"]).sum()), int(words.max())
        assert drawn["copies"].max() - drawn["copies"].min() <= 1 and abs(taken - target) <= (most if n < 3000 else 1)


def test_splitting_tree_is_exact(spark):
    quotas = {"a": 700, "b": 31, None: 5, "c": 0}
    split = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, n long"), 37).collect()
    sums, shards = Counter(), Counter()
    for r in split:
        sums[r.source] += r.n
        shards[r.shard] += r.n
    assert sums == Counter({k: v for k, v in quotas.items() if v})
    assert set(shards) == set(range(37)) and max(shards.values()) - min(shards.values()) <= 6


# ---------------------------------------------------------------- op6

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((*m.span(), kind))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_on_random_texts():
    rng = np.random.default_rng(1)
    letters = list("ab1.9@+-_ 0()2.5")
    for _ in range(5_000):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("edge", [False, True])
def test_personal_data(spark, edge):
    rows = EDGE_TEXTS if edge else documents("/root/testdata/sf0.01")
    got = pii.find_personal_data(edge_docs(spark, rows, extra=("spans", "p"))).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        base = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in pii.KINDS)
        assert not base or set(joined.split(",")) <= set(r.spans.split(","))


def test_boosted_trees_add_written_out_forms_only():
    rows = [x for _, text, *_ in documents("/root/testdata/sf0.1") for x in pii.training_rows(text)]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    held = np.arange(len(y)) % 3 == 0
    model = pii.BoostedTrees()
    model.fit(x[~held], y[~held])
    model.calibrate(x[held], y[held])
    assert ((model.probability(x[held]) > 0.5) == y[held]).mean() > 0.97
    for text, value in (("write to jane.doe at mail dot example dot com now", "jane.doe at mail dot example dot com"),
                        ("call (368) 555-0098 today", "(368) 555-0098"), ("card 4539.5787.6362.1486 ok", "4539.5787.6362.1486")):
        assert [text[a:b] for a, b, _ in pii.all_spans(text, pii.base_spans(text), model)] == [value]
    for clean in ("she was at dot net and", "version 1.2.3.4567 of it", "in the year 1984 it was 25 degrees", "1000000 people"):
        assert pii.all_spans(clean, [], model) == []


def test_redaction(spark):
    got = {r.doc_id: r for r in pii.redact(edge_docs(spark)).collect()}
    assert got[11].text == "Mail [email] or call [phone], card [card], at [ip].\nUnder the MIT License." and got[11].n_chars == len(got[11].text)
    assert got[4].text is None and got[1].text == EDGE_TEXTS[0][1]
    assert pii.redact(edge_docs(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- op7


def check_packing(rows, got, capacity=2048):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.TOKENIZER)
    expected = []
    for doc, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        start, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
        while start < len(ids):
            expected.append((doc, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, stop, piece = stop, stop + capacity, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("edge", [False, True])
def test_packing(spark, edge):
    rows = EDGE_TEXTS if edge else documents()
    docs = edge_docs(spark, rows, extra=("piece", "length", "salt", "number"))
    used, least = check_packing(rows, packing.pack(docs).collect())
    assert used <= 1.02 * least + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_plans_place_every_piece():
    rng = np.random.default_rng(2)
    for _ in range(30):
        capacity = int(rng.integers(1, 80))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 12))
        histogram = {int(length): int(rng.integers(1, 400)) for length in lengths}
        for sequences in (packing.plan(histogram, capacity, 5), packing._plan(histogram, capacity, 3, 8)):
            placed = Counter()
            for count, filling in sequences:
                assert sum(length * k for length, k in filling) <= capacity
                for length, k in filling:
                    placed[length] += count * k
            assert placed == Counter(histogram)


def test_chunked_tokens_equal_whole_texts():
    known = tokens.tokenizer()
    for text in ("", " ", "a ", "  a", "a  b\n c", " a", "é ß", "<|endoftext|> a", "中文  x", "x\x1c y", "a  b", "it's o'clock", *(r[1] for r in documents()[:50])):
        assert known.ids(text) == known._encode(text), text


def test_ranks_and_file_agree_on_every_common_character():
    known = tokens.tokenizer()
    common = [chr(c) for c in range(1, 0x250)]
    for c in common:
        for text in (f"a{c}1 {c}{c}a.{c} \n{c}  {c}b {c}  ", *(f"{c}{d}" for d in "a1 .\n'\t\x85\xa0")):
            assert known.ids(text) == known._encode(text), text
    draw = random.Random(5)
    for _ in range(3_000):
        text = "".join(draw.choices(common + [" "] * 200 + ["\n"] * 80 + list("'stremvdl") * 10, k=60))
        assert known.ids(text) == known._encode(text), text


# ---------------------------------------------------------------- op8


def brute_repeats(rows, length=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    for doc, value in sorted(((d, v) for d, v in data if d is not None), key=lambda x: x[0]):
        for i in range(len(value) - length + 1):
            first.setdefault(value[i : i + length], doc)
    out = []
    for doc, value in data:
        gone = bytearray(len(value))
        for i in range(len(value) - length + 1):
            if doc is not None and first[value[i : i + length]] < doc:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(v for v, g in zip(value, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(value), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return Counter(out)


def test_repeated_strings_of_given_table(spark):
    got = substrings.remove_repeated(spark.read.parquet(f"{SF}/documents.parquet"), with_kept=True).collect()
    assert Counter(tuple(r)[:5] + (bytes(r.kept),) for r in got) == brute_repeats(documents())


def test_repeated_strings_edges(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 1 << 12)  # long texts become segments
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdef "), 400))
    rows = [r for r in EDGE_TEXTS if r[0] not in (9, 10)] + [(9, "x" * 12_000, "en", "a"), (10, "x" * 60 + passage * 2, "en", "a")]
    for i in range(20, 60):
        noise = ["".join(rng.choice(list("abcdefgh "), rng.integers(0, 120))) for _ in range(2)]
        cut = int(rng.integers(0, 350))
        rows.append((i, noise[0] + passage[cut : cut + int(rng.integers(40, 200))] + noise[1], "en", "a"))
    rows += [(3, "another row of the same id " * 5, "en", "a"), (None, passage, "en", "a")]
    docs = edge_docs(spark, rows, extra=("key", "codes", "runs", "n_bytes")).repartition(4)
    got = substrings.remove_repeated(docs, with_kept=True).collect()
    assert Counter(tuple(r)[:5] + (bytes(r.kept),) for r in got) == brute_repeats(rows)
    for crowd in (1, 3):  # many batches, whose crowded anchor words skip the key ranges
        got = substrings.remove_repeated(docs, with_kept=True, batch=100, crowd=crowd).collect()
        assert Counter(tuple(r)[:5] + (bytes(r.kept),) for r in got) == brute_repeats(rows)
    assert substrings.remove_repeated(docs.limit(0)).count() == 0


def test_a_crowded_anchor_word_adds_few_entries_of_a_batch():
    rng = np.random.default_rng(5)
    noise = lambda: bytes(rng.integers(97, 123, 60, dtype=np.uint8))
    passage = bytes(rng.integers(97, 123, 300, dtype=np.uint8))
    most = []
    for documents in (500, 2_000):
        texts, parts = [noise() + passage + noise() for _ in range(documents)], []
        for chunk in substrings.chunks(texts):
            first, _, a, b = chunk.runs()
            parts.append((a, b, chunk.doc[first]))
        main, _ = substrings.sorted_entries(*(np.concatenate(c) for c in zip(*parts)))
        kept, known = substrings.crowded(*main, substrings.CROWD)
        assert len(known[0]) >= documents  # at least an end has a content for each document
        most.append(np.unique(kept[0] >> np.uint64(16), return_counts=True)[1].max())
        rest = {(x, y) for x, y in zip(main[0], main[1])} - {(x, y) for x, y in zip(kept[0], kept[1])}
        assert rest <= {(x, y) for x, y in zip(known[0], known[1])}
    assert max(most) <= substrings.CROWD


def test_runs_of_one_anchor_are_told_apart_by_their_content():
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, 200, dtype=np.uint8)) for _ in range(2_000)]
    seen = set()
    for chunk in substrings.chunks(texts):
        first, last, a, b = chunk.runs()
        content = [texts[chunk.doc[f]][chunk.place[f] : chunk.place[l] + substrings.LENGTH] for f, l in zip(first, last)]
        seen |= {((int(x) & 0xFFFF) << 48 | int(y), c) for x, y, c in zip(a, b, content)}
        wide = substrings._unpack(substrings._pack(a, b, chunk.doc[first]))
        assert (wide[0] == a).all() and (wide[1] == b).all() and (wide[2] == chunk.doc[first]).all()
    assert len({k for k, _ in seen}) == len({c for _, c in seen}) == len(seen) > 10_000
    for bit in range(64):  # every one of the content's bits takes part, and none follows from others
        share = np.mean([k >> bit & 1 for k, _ in seen])
        assert 0.45 < share < 0.55, bit


def test_levels_report_all_but_the_smallest_document():
    rng = np.random.default_rng(4)
    index, reported, seen = substrings.LogIndex(), [], defaultdict(set)
    for _ in range(40):
        a, b, doc = rng.integers(0, 50, 30).astype(np.uint64), rng.integers(0, 2, 30).astype(np.uint16), rng.integers(0, 1_000, 30)
        for entry in zip(a.tolist(), b.tolist(), doc.tolist()):
            seen[entry[:2]].add(entry[2])
        main, others = substrings.sorted_entries(a, b, doc)
        packed = substrings._unpack(substrings._pack(*main))
        reported += [*zip(*others), *zip(*index.add(*packed))]
    expected = {(a, b, d) for (a, b), docs in seen.items() for d in docs if d != min(docs)}
    assert {tuple(map(int, r)) for r in reported} == expected
    sizes = [len(level[0]) for level in index.levels]
    assert all(x > y for x, y in zip(sizes, sizes[1:]))


def test_small_arrays_are_joined_before_they_are_looked_up(monkeypatch):
    rng = np.random.default_rng(9)
    calls, add, seen, rows = [], substrings.LogIndex.add, defaultdict(set), []
    monkeypatch.setattr(substrings.LogIndex, "add", lambda self, *entries: calls.append(len(entries[0])) or add(self, *entries))
    for batch in range(300):  # as many batches as some GB of text have, a few entries of each in this key range
        a, b, doc = rng.integers(0, 9_000, 40).astype(np.uint64), np.zeros(40, np.uint64), rng.integers(0, 10**6, 40)
        for x, d in zip(a.tolist(), doc.tolist()):
            seen[x].add(d)
        main, others = substrings.sorted_entries(a, b, doc)
        rows.append((batch, substrings._pack(*main), substrings._pack(*others), None))
    group = pd.DataFrame(rows, columns=["batch", "data", "repeats", "asked"])
    got = substrings._looked_up(group, shared=False)
    assert len(calls) <= 300 * 40 // substrings.INDEX_ENTRIES + 1
    code = {x: int(substrings.code(np.array([x], np.uint64), np.zeros(1, np.uint64))[0]) for x in seen}
    assert {(r.doc_id, r.code) for r in got.itertuples()} == {(d, code[x]) for x, docs in seen.items() for d in docs if d != min(docs)}
    empty = group.assign(data=None, repeats=None)
    assert len(substrings._looked_up(empty, shared=True)) == 0


def test_arrays_are_not_cut_finer_as_the_input_grows():
    for gigabytes in (1, 6, 10, 30, 100):  # of text
        buckets, entries = substrings._extent(gigabytes << 30, substrings.BATCH_ENTRIES)
        assert entries / buckets >= 500
    assert substrings._extent(0, 100) == (substrings.LEAST_BUCKETS, 100)
    rng = np.random.default_rng(10)
    a, doc = rng.integers(0, 1 << 63, 10_000).astype(np.uint64), np.arange(20_000)
    (frame,) = substrings._blobs(iter([(np.tile(a, 2), np.tile(a, 2) >> np.uint64(16), doc)]), 4_096, substrings.CROWD)
    parts = [substrings._unpack(p) for p in frame["repeats"].dropna()]  # decided by the batch: no part for each key range
    assert len(parts) <= 10_000 // substrings.PART_ENTRIES + 1
    assert sorted(np.concatenate([p[2] for p in parts]).tolist()) == list(range(10_000, 20_000))
    assert sum(len(substrings._unpack(p)[0]) for p in frame["data"].dropna()) == 10_000


def test_shuffles_of_a_stored_step_are_dropped(spark):
    before = spark.conf.get(common.CLEANUP_SETTING)
    with common.shuffles_dropped(spark):
        assert spark.conf.get(common.CLEANUP_SETTING) == "true"
        got = stored(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(common.CLEANUP_SETTING) == before
    assert sorted(map(tuple, got.collect())) == [(k, len(range(k, 1_000, 7))) for k in range(7)]


def test_marks_are_those_of_the_own_list():
    rng = np.random.default_rng(11)
    doc, codes = np.sort(rng.integers(3, 40, 5_000)), rng.integers(-20, 20, 5_000) << 58
    wanted = [rng.integers(-20, 20, rng.integers(0, 6)) << 58 for _ in range(45)]
    expected = [c in set(wanted[d].tolist()) for d, c in zip(doc.tolist(), codes.tolist())]
    assert substrings._marks(doc, codes, wanted).tolist() == expected
    assert substrings._marks(doc, codes, [w[:0] for w in wanted]).sum() == 0 == len(substrings._marks(doc[:0], codes[:0], wanted))


# ---------------------------------------------------------------- op9


@pytest.mark.parametrize("edge", [False, True])
def test_quality_measures(spark, edge):
    rows = [r for r in (EDGE_TEXTS if edge else documents()) if r[0] != 10]
    rows += [(900, "a b\na b\n\n \nc # $\na b", "en", "z")]
    got = quality.judge(edge_docs(spark, rows, extra=("host", "n", "rejected", "m"))).collect()
    expected = Counter()
    for doc, text, *_ in rows:
        words, lines = WORD.findall(text or ""), (text or "").split("\n")
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        seen, duplicates = set(), 0
        for line in lines:
            if WORD.search(line):
                duplicates += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        expected[doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(repeated), failed] += 1
    assert Counter(tuple(r)[:7] for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(edge_docs(spark).limit(0)).count() == 0


def test_bad_host_is_rejected_and_small_one_is_not(spark):
    good, bad = "one two three four five six seven " + " ".join(f"w{i}" for i in range(60)), "# $ % & " * 2
    rows = [(i, good, "en", f"good{i % 5}") for i in range(200)] + [(1000 + i, bad, "en", "bad") for i in range(40)]
    rows += [(2000, good, "en", "bad"), (2001, bad, "en", "small"), (2002, good, "en", "small")]
    kept = {r.doc_id: r.kept for r in quality.judge(edge_docs(spark, rows)).collect()}
    assert not kept[2000] and kept[2002] and kept[0] and not kept[2001]


def test_quality_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = catalog.op9_quality(spark, SF)
    expected = con.sql(catalog.ORACLES["op9_quality"])
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


# ---------------------------------------------------------------- op10


@pytest.mark.parametrize("edge", [False, True])
def test_license_scan(spark, edge):
    rows = (EDGE_TEXTS if edge else documents("/root/testdata/sf0.01")) + [(950, "Under the MIT-license, under THE mit license; ünder the mit license CC BY-NC", "en", "a")]
    got = licenses.license_scan(edge_docs(spark, rows, extra=("labels", "found", "score"))).collect()
    expected = Counter()
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        expected[doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert Counter(tuple(r)[:6] for r in got) == expected
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_notices_are_found_with_errors_and_not_in_prose():
    for text, label in (("Released undr the MIT Licence.", "mit"), ("under the GNU General Publc License, version 3", "gpl-3"),
                        ("Licensed under the Apache Licence, Version 2.0", "apache-2"), ("All rigths reserved", "all-rights-reserved")):
        assert label in licenses.scan(text)[5].split(","), text
    assert licenses.scan("the general publishes version after version of all the ripe fruit")[5] == ""
    search = licenses.NoticeSearch(notices={"mozilla public license version 2": "mpl-2"}, error_chars=9)
    phrase = "mozilla public license version 2"
    rng = np.random.default_rng(6)
    for _ in range(300):  # no notice within its errors is lost
        value = list(phrase)
        for place in rng.choice(np.arange(1, len(phrase) - 1), 3, replace=False):
            value[place] = "q"
        assert search.fuzzy("xx " + "".join(value) + " yy"), "".join(value)


def test_notices_beside_better_ones_are_found():
    two, three = "gnu generel public licence version 2", "gnu general public license version 3"
    for parts, labels in (((two, three), ["gpl-2", "gpl-3"]), ((three, two), ["gpl-3", "gpl-2"]), ((two, three, two, two, three), ["gpl-2", "gpl-3", "gpl-2", "gpl-2", "gpl-3"])):
        for between in (" ", " or ", " some more words stand here and there "):
            spans = licenses.scan(between.join(parts))[7].split(",")
            assert [s.split(":")[0] for s in spans] == labels
            assert all(int(s.split(":")[2]) - int(s.split(":")[1]) == 6 for s in spans)
    worse, better = "undr the mit licence", "under the mit license"
    for parts in ((worse, better), (better, worse), (worse, worse, better), (worse, better, worse), (worse,) * 30 + (better,)):
        assert len(licenses.scan(" ".join(parts))[7].split(",")) == len(parts)


def test_segments_give_every_string_once(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (10, 49, 50, 51, 700, 3_000, 0, 200)]
    whole = {(d, i) for d, t in enumerate(texts) for i in range(len(t) - substrings.LENGTH + 1)}
    expected = {p: substrings.code(*c.windows()[1:])[k] for c in substrings.chunks(texts) for k, p in enumerate(zip(c.doc[c.windows()[0]], c.place[c.windows()[0]]))}
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 256)
    found = Counter()
    for chunk in substrings.chunks(texts):
        at, a, b = chunk.windows()
        for place, value in zip(zip(chunk.doc[at], chunk.place[at]), substrings.code(a, b)):
            found[place] += 1
            assert expected[place] == value
        first, last, *_ = chunk.runs()
        assert sum(last - first + 1) == len(at)
    assert set(found) == whole == set(expected) and set(found.values()) == {1}
