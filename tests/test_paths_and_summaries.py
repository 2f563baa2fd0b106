"""Paths, components by day, merging aggregates, cubes, trailing windows and local days."""

from __future__ import annotations

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

import oracle  # noqa: F401
from talktrace.functions import calendar
from talktrace.operators import paths, summaries
from talktrace.plans import catalog


def _both(spark, edges):
    pairs = {p for x, y in edges for p in ((x, y), (y, x))}
    return spark.createDataFrame(sorted(pairs), "x string, y string")


def _nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


@pytest.mark.parametrize("shape", ["chain", "cycle", "random"])
def test_hop_distances(spark, rows, shape):
    draw = random.Random(5)
    names = [f"n{i}" for i in range(6)]
    edges = {
        "chain": list(zip(names, names[1:])), "cycle": list(zip(names, names[1:] + names[:1])), "star": [(names[3], n) for n in names if n != names[3]],
        "random": [tuple(draw.sample(names, 2)) for _ in range(5)] + [("n1", "n1")],
    }[shape]
    near = defaultdict(set)
    for x, y in edges:
        near[x].add(y)
        near[y].add(x)
    hops, queue = {"n0": 0}, deque(["n0"])
    while queue:
        at = queue.popleft()
        for y in near[at] - set(hops):
            hops[y] = hops[at] + 1
            queue.append(y)
    everyone = _nodes(spark, names + ["alone"])
    got = rows(paths.hop_distances(_both(spark, edges), _nodes(spark, ["n0"]), everyone), "entity", "hops")
    assert got == {(n, hops.get(n)) for n in names + ["alone"]}
    short = rows(paths.hop_distances(_both(spark, edges), _nodes(spark, ["n0"]), everyone, most=2), "entity", "hops")
    assert short == {(n, h if (h := hops.get(n)) is not None and h <= 2 else None) for n in names + ["alone"]}


def _roots(edges):
    parent = {}

    def find(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            n = parent[n]
        return n

    for x, y in edges:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def test_components_grow_by_day_as_if_recomputed(spark, rows):
    draw = random.Random(7)
    edges = [(draw.randint(1, 3), draw.randint(1, 40), draw.randint(1, 40)) for _ in range(27)] + [(1, i, i + 1) for i in range(100, 120)] + [(2, 200, 200)]
    got = rows(paths.components_by_day(spark.createDataFrame(edges, "day int, x long, y long"), 1, 3), "day", "node", "component")
    expected = {(d, n, c) for d in range(1, 4) for n, c in _roots([e[1:] for e in edges if e[0] <= d]).items()}
    assert got == expected
    one = spark.createDataFrame([(x, y) for _, x, y in edges], "x long, y long")
    assert rows(paths.components(one), "node", "component") == set(_roots([e[1:] for e in edges]).items())
    assert paths.components(one.limit(0)).count() == 0


def test_percentiles_of_merged_histograms(spark, rows):
    draw = random.Random(1)
    data = [(draw.randint(1, 4), draw.choice("ab"), draw.choice([None, *range(9)])) for _ in range(400)] + [(1, "c", 5)]
    frame = spark.createDataFrame(data, "day int, entity string, v int")
    got = rows(summaries.percentiles(summaries.value_histogram(frame, "v", ["day", "entity"]), ["entity"], (0, 50, 90, 100)), "entity", "n", "p0", "p50", "p90", "p100")
    expected = set()
    for e in "abc":
        own = sorted(v for _, x, v in data if x == e and v is not None)
        expected.add((e, len(own), *(own[max(0, -(-len(own) * p // 100) - 1)] for p in (0, 50, 90, 100))))
    assert got == expected


def test_sketches_merge_and_keep_their_error(spark):
    frame = spark.range(200_000).select((F.col("id") % 5).alias("day"), F.lit("a").alias("entity"), (F.col("id") % 50_000).alias("v"))
    stored = summaries.distinct_sketches(frame, "v", ["day", "entity"])
    estimate = summaries.distinct_counts(stored, ["entity"]).first().estimate
    assert abs(estimate - 50_000) <= 50_000 * 3 * 1.04 / 2**7
    part = summaries.distinct_counts(stored.where("day < 2"), ["entity"]).first().estimate
    assert abs(part - 20_000) <= 20_000 * 3 * 1.04 / 2**7


def test_cube_counts_each_level_exactly(spark, rows):
    draw = random.Random(2)
    data = [(draw.randint(1, 3), draw.choice(["x", "y", None]), draw.choice("pqr"), draw.randint(1, 4)) for _ in range(120)]
    frame = spark.createDataFrame(data, "day int, kind string, author string, n int")
    got = Counter(map(tuple, summaries.cube_counts(frame, ["day", "kind"], "n", "author").select("day", "kind", "level", "n", "distinct").collect()))
    expected = Counter()
    for level in range(4):
        cells = defaultdict(list)
        for d, k, a, n in data:
            cells[None if level & 2 else d, None if level & 1 else k].append((a, n))
        for (d, k), own in cells.items():
            expected[d, k, level, sum(n for _, n in own), len({a for a, _ in own})] += 1
    assert got == expected


def test_trailing_windows_count_absent_days_as_zero(spark, rows):
    data = [(1, "a", 7), (7, "a", 7), (8, "a", 14), (30, "a", 7), (8, "b", 70)]
    got = rows(summaries.trailing(spark.createDataFrame(data, "day int, entity string, n int")), "day", "entity", "mean", "change")
    assert got == {(1, "a", 1.0, 1.0), (7, "a", 2.0, 2.0), (8, "a", 3.0, 2.0), (30, "a", 1.0, 1.0), (8, "b", 10.0, 10.0)}


def test_local_days_where_clocks_change(spark):
    # 2024-03-31 has 23 hours in the zone, 2024-10-27 has 25; days are counted from the first.
    zone = "Europe/Berlin"
    start = 1_711_839_600  # 2024-03-31 00:00 there
    moments = [(start - 1, 0), (start, 1), (start + 23 * 3600 - 1, 1), (start + 23 * 3600, 2)]
    autumn = 1_729_980_000  # 2024-10-27 00:00 there
    moments += [(autumn - 1, 210), (autumn, 211), (autumn + 25 * 3600 - 1, 211), (autumn + 25 * 3600, 212)]
    frame = spark.createDataFrame(moments, "epoch bigint, expected int")
    got = frame.select(calendar.local_day_index(F.col("epoch"), zone, "2024-03-31").alias("day"), "expected")
    shown = got.select("day", "expected", calendar.local_day_hours(F.col("day"), zone, "2024-03-31").alias("hours")).collect()
    assert all(r.day == r.expected and r.hours == {1: 23, 211: 25}.get(r.day, 24) for r in shown)


def test_a_pull_reads_its_submissions_once(spark):
    plan = catalog.QUERIES["ingest_since"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
