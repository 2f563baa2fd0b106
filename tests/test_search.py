"""The search index: updates by day, and searches that read postings only."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from talktrace.operators import search
from talktrace.sources.index import SearchIndex

BODIES = [
    (1, 1, "the cat and the dog"), (2, 1, "Cat cat CAT"), (3, 1, None), (4, 2, ""), (5, 2, "a dog's life, the dog"),
    (6, 2, "naïve Élan the cat"), (7, 3, "nothing here"), (8, 3, "the the the the the the cat"), (9, 4, "!!! ..."), (10, 4, "dog cat"), (11, 4, "dog cat"),
]
QUERIES = [(1, "cat dog"), (2, "THE the élan"), (3, "absent"), (4, ""), (5, None)]


def messages(spark, rows):
    return spark.createDataFrame(rows, "message_id bigint, day int, body string")


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id bigint, query string")


def brute(rows, k):
    texts = {i: Counter(re.findall(r"[\w']+", (b or "").lower())) for i, _, b in rows}
    texts = {i: c for i, c in texts.items() if c}
    mean = sum(sum(c.values()) for c in texts.values()) / len(texts)
    out = set()
    for query, text in QUERIES:
        scores = defaultdict(float)
        for term in set(re.findall(r"[\w']+", (text or "").lower())):
            df = sum(term in c for c in texts.values())
            for i, c in texts.items():
                if c[term]:
                    scores[i] += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1):
            out.add((query, rank, i, round(s, 6)))
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_against_brute_force(spark, rows, k):
    found = search.postings(messages(spark, BODIES))
    got = rows(search.search(found, asked(spark), k), "query_id", "rank", "message_id", "score")
    assert {r[:3] for r in got} == {r[:3] for r in brute(BODIES, k)}
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got), sorted(brute(BODIES, k))))
    assert search.search(found.limit(0), asked(spark), k).count() == 0


def test_postings_of_some_terms_serve_a_search_for_them(spark, rows):
    columns = ("term", "message_id", "tf", "length", "lead")
    whole, some = search.postings(messages(spark, BODIES)), search.postings(messages(spark, BODIES), only=["cat", "absent"])
    assert rows(some, *columns) == {r for r in rows(whole, *columns) if r[0] == "cat" or r[4]} < rows(whole, *columns)
    cats = spark.createDataFrame([(1, "Cat absent")], "query_id bigint, query string")
    ranked = ("query_id", "rank", "message_id", "score")
    assert rows(search.search(some, cats), *ranked) == rows(search.search(whole, cats), *ranked)


def test_the_least_term_is_found_once_for_a_text(spark):
    """It used to be found for each of a text's terms, by looking at all of them."""
    plan = search.postings(messages(spark, BODIES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 1 and plan.index("Generate") < plan.index("array_min")
    assert plan.count("regexp_extract_all") == 1


def test_postings_are_shuffled_before_queries_multiply_them(spark):
    """Each posting used to be shuffled once for every query that holds its term."""
    found = search.search(search.postings(messages(spark, BODIES)), asked(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(message_id#", plan)
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, message_id", plan)


def test_index_updates_equal_a_rebuild(spark, rows):
    index = SearchIndex(spark, "search_updates")
    columns = ("term", "message_id", "day", "tf", "length", "lead")
    index.update(messages(spark, BODIES[:5]))
    index.update(messages(spark, BODIES[3:9]))
    changed = [(7, 4, "moved to another day"), (8, 3, "a new text"), (2, 1, None)]  # a move, an edit, one that lost its text
    index.update(messages(spark, changed + BODIES[9:]))
    now = {r[0]: r for r in BODIES + changed}
    assert rows(index.postings(), *columns) == rows(search.postings(messages(spark, list(now.values()))), *columns)
    index.update(messages(spark, [(8, 4, "the last of its day has moved")]))
    now[8] = (8, 4, "the last of its day has moved")
    assert rows(index.postings(), *columns) == rows(search.postings(messages(spark, list(now.values()))), *columns)
    assert not index.postings(3, 3).count()
    index.update(messages(spark, []))
    got = rows(index.search(asked(spark), 5), "query_id", "rank", "message_id")
    assert got == {r[:3] for r in brute(list(now.values()), 5)}


def test_days_that_lose_their_words_and_messages_without_a_day(spark, rows):
    index = SearchIndex(spark, "search_days")
    columns = ("term", "message_id", "day", "tf", "length", "lead")
    index.update(messages(spark, [(1, 1, "one cat"), (2, 2, "two cats"), (3, None, "a cat of no day")]))
    index.update(messages(spark, [(1, 1, "..."), (4, None, "another cat")]))
    assert index.postings(1, 1).count() == 0
    assert {r[0] for r in rows(index.find("cat"), "message_id")} == {3, 4}
    assert {r[0] for r in rows(index.postings(None, 5), "message_id")} == {2}
    index.update(messages(spark, [(3, 2, "found its day"), (4, None, None)]))
    assert rows(index.postings(), *columns) == rows(
        search.postings(messages(spark, [(2, 2, "two cats"), (3, 2, "found its day")])), *columns)


def test_a_search_reads_terms_and_days_only(spark, rows):
    index = SearchIndex(spark, "search_reads")
    index.update(messages(spark, BODIES))
    one = index.find("cat dog", 3, 1, 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \\[[^]]*day#\\d+ >= 1\\)?, \\(day#\\d+ <= 3".replace("\\\\", "\\"), plan)
    assert re.search(r"PushedFilters: \[[^]]*In\(term, \[cat,dog\]\)", plan)
    expected = {r[1:3] for r in brute([b for b in BODIES if b[1] <= 3], 3) if r[0] == 1}
    assert rows(one, "rank", "message_id") == expected
