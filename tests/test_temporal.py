"""Joins on time against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from talktrace.operators import temporal


def _plain(row):
    return None if row is None else tuple(row)


@pytest.mark.parametrize("bucket", [1, 7, 3_600])
def test_asof_join_against_brute_force(spark, bucket):
    draw = random.Random(bucket)
    left = [(i, draw.choice(["a", "a", "a", "b", "c", None]), draw.choice([None, draw.randint(-50, 200)])) for i in range(300)] * 2
    right = [(draw.choice(["a", "a", "b", None]), draw.choice([None, draw.randint(-30, 220)]), draw.randint(0, 5)) for _ in range(120)]
    lefts = spark.createDataFrame(left, "id int, key string, time int")
    rights = spark.createDataFrame(right, "key string, at int, value int")

    def last(keys, key, time):
        able = [r for r in right if r[1] is not None and time is not None and r[1] <= time and (not keys or key is not None and r[0] == key)]
        return max(able, key=lambda r: (r[1], r[0] is not None, r[0] or "", r[2]), default=None)

    for by in ([], ["key"]):
        got = Counter((r.id, r.key, r.time, _plain(r.match)) for r in temporal.asof_join(lefts, rights, "time", "at", by, bucket).collect())
        assert got == Counter((*row, last(by, row[1], row[2])) for row in left)
    recent = temporal.asof_join(lefts, rights, "time", "at", ["key"], bucket, within=5).collect()
    for r in recent:
        expected = last(["key"], r.key, r.time)
        assert _plain(r.match) == (expected if expected and r.time - expected[1] <= 5 else None)


def test_asof_join_of_empty_sides(spark):
    lefts, rights = spark.createDataFrame([(1, 5)], "id int, time int"), spark.createDataFrame([(3, "x")], "at int, value string")
    assert temporal.asof_join(lefts.limit(0), rights, "time", "at").count() == 0
    assert temporal.asof_join(lefts, rights.limit(0), "time", "at").collect()[0].match is None
    assert temporal.asof_join(lefts, rights, "time", "at").collect()[0].match.value == "x"


@pytest.mark.parametrize("grain", [1, 5, 64])
def test_interval_join_against_brute_force(spark, grain):
    draw = random.Random(grain)
    points = [(i, draw.choice(["a", "a", "b", None]), draw.choice([None, draw.randint(-100, 900)])) for i in range(200)]
    spans = []
    for i in range(80):
        start = draw.choice([None, draw.randint(-150, 950)])
        spans.append((i, draw.choice(["a", "b", "c", None]), start, draw.choice([None, (start or 0) + draw.choice([-3, 0, 1, 40, 700])])))
    spans += [(1_000, "a", 5, 20)] * 2
    p, s = spark.createDataFrame(points, "id int, key string, time int"), spark.createDataFrame(spans, "no int, key string, start int, stop int")

    def holds(keys, point, span):
        inside = point[2] is not None and (span[2] is None or span[2] <= point[2]) and (span[3] is None or point[2] <= span[3])
        return inside and not (span[2] is not None and span[3] is not None and span[3] < span[2]) and (not keys or point[1] is not None and point[1] == span[1])

    for by in ([], ["key"]):
        got = temporal.interval_join(p, s, "time", "start", "stop", by, grain).select("point.id", "span.no").collect()
        assert Counter(map(tuple, got)) == Counter((a[0], b[0]) for a in points for b in spans if holds(by, a, b))
    assert temporal.interval_join(p.limit(0), s, "time", "start", "stop").count() == 0
    assert temporal.interval_join(p, s.limit(0), "time", "start", "stop").count() == 0


def test_overlap_join_against_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("ab"), start := draw.randint(0, 60), draw.choice([None, start + draw.randint(-1, 20)])) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, key string, start int, stop int")
    got = temporal.overlap_join(frame, frame, "start", "stop", ["key"]).select("left.id", F_alias("right.id")).collect()

    def meets(a, b):
        end = [10**6 if r[3] is None else r[3] for r in (a, b)]
        return a[1] == b[1] and a[2] <= end[0] and b[2] <= end[1] and a[2] <= end[1] and b[2] <= end[0]

    assert Counter(map(tuple, got)) == Counter((a[0], b[0]) for a in rows for b in rows if meets(a, b))


def F_alias(name):
    from pyspark.sql import functions as F

    return F.col(name).alias("other")


def test_a_long_span_is_few_rows_and_no_pairs_are_tried(spark):
    points = spark.range(10_000).select("id")
    spans = spark.createDataFrame([(0, 9_998), (1, 1), (None, None)], "start long, stop long")
    frame = temporal.interval_join(points, spans, "id", "start", "stop")
    assert frame.count() == 9_999 + 1 + 10_000
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    cells = spans.limit(1).select(temporal._cells(temporal.F.col("start"), temporal.F.col("stop") + 1, 14).alias("c")).first().c
    assert len(cells) <= 28 and sum(1 << c.level for c in cells) == 9_999
