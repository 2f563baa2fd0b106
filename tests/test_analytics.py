"""Rosters, daily series, sentiment, timeline, moments and exits on small cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talktrace.functions import calendar, labels
from talktrace.operators import codes, daily, moments, postexit, roster, sentiment, timeline

DAY = 86_400


def test_day_index_floors_before_the_origin(spark):
    times = spark.createDataFrame([(t,) for t in (1000, 1000 + DAY - 1, 1000 + DAY, 999)], "t long")
    assert [r[0] for r in times.select(calendar.day_index(F.col("t"), 1000)).collect()] == [1, 1, 2, 0]


def test_recency_buckets(spark):
    ages = {300: "hour", 3600: "hour", 3601: "day", 3 * DAY: "week", 20 * DAY: "month", 200 * DAY: "year", 730 * DAY: "all"}
    times = spark.createDataFrame([(10**9 - a,) for a in ages], "t long")
    got = times.select(calendar.recency_bucket(F.col("t"), F.lit(10**9))).collect()
    assert [r[0] for r in got] == list(ages.values())


def test_thread_types(spark):
    titles = {
        "Daily Discussion": "MID", "POST episode": "POST", "Daily Discussion post": "MID",
        "daily discussion": "PRE", "Episode 3": "PRE",
    }
    frame = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in frame.select(labels.thread_type(F.col("t"))).collect()] == list(titles.values())


def test_sentiment_label_prefers_the_positive_limit(spark):
    frame = spark.createDataFrame([(-0.5,), (0.0,), (0.5,), (None,)], "c double")
    label = lambda lo, hi: [r[0] for r in frame.select(labels.sentiment_label(F.col("c"), lo, hi)).collect()]
    assert label(-0.1, 0.1) == [-1, 0, 1, 0]
    assert label(0.6, -0.6) == [1, 1, 1, 0]


def test_roster_cleaning(spark):
    raw = spark.createDataFrame(
        [
            ("A", "22", "X", "Day 1", "Participating"),
            ("B", "23", "X", "Day 271", "Dumped (Day 31)"),
            ("C", "24", "X", "Day 27", "Participating"),
            ("D", "25", "X", "Day 30", "Dumped (Day 40)"),
            ("E", "x", "X", "unknown", "Winner (Day 58)"),
            (None, "1", "X", "Day 2", "x"),
        ],
        "Islander string, Age string, Hometown string, Entered string, Status string",
    )
    got = {r[0]: tuple(r)[1:] for r in roster.clean_roster(raw).drop("hometown").collect()}
    assert got == {
        "A": (22, 1, None, None, 1),
        "B": (23, 27, 31, "Dumped", None),
        "C": (24, 27, None, None, 31),
        "D": (25, 30, 40, "Dumped", 30),
        "E": (None, None, 58, "Winner", None),
    }


def _roster(spark, *stints):
    return spark.createDataFrame(
        list(stints), "entity string, entry_day int, leave_day int, leave_status string, main_entry_day int"
    )


def test_cohorts_and_selection(spark):
    people = _roster(
        spark, ("A", 26, 30, "Dumped", None), ("B", 1, 20, "Dumped", 1), ("C", 4, None, None, 4), ("D", 4, 58, "Winner", 4)
    )
    flags = {r["entity"]: tuple(r[c] for c in roster.COHORTS) for r in roster.with_cohorts(people).collect()}
    assert flags == {
        "A": (True, False, True, False, False),
        "B": (False, True, False, False, False),
        "C": (False, False, True, True, True),
        "D": (False, False, True, True, False),
    }
    picked = lambda *c: {r[0] for r in roster.pick_entities(people, *c).collect()}
    assert picked() == {"C", "D"}
    assert picked(["original", "late_arrival"]) == {"A", "B"}
    with pytest.raises(ValueError):
        roster.pick_entities(people, ["nobody"])


def test_last_exit_counts(spark):
    people = _roster(
        spark, ("A", 1, 19, "Dumped", 1), ("A", 27, 58, "Fourth", None), ("B", 1, 5, "Dumped", 1), ("B", 9, None, None, 9)
    )
    assert [tuple(r) for r in roster.last_exits(people).collect()] == [("A", 58)]


def _daily(spark, *cells):
    return spark.createDataFrame(list(cells), "day int, entity string, n long")


def _picked(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


def test_spread_counts_absent_entities_as_zero(spark):
    series = _daily(spark, (1, "A", 2), (1, "D", 6), (2, "A", 5))
    got = {r["day"]: (r["mean"], r["std"]) for r in daily.daily_spread(series, 4).collect()}
    assert got[1] == pytest.approx((2, math.sqrt(8)))
    assert got[2] == pytest.approx((1.25, 2.5))
    assert {r["day"] for r in daily.daily_spread(series, 4, 1, 1).collect()} == {1}
    assert {r["day"] for r in daily.daily_spread(series, 4, 1, 1, extra_days=1).collect()} == {1, 2}


def test_spread_is_stable_for_large_values(spark):
    series = _daily(spark, *[(1, str(i), 10**9 + i) for i in range(4)])
    assert daily.daily_spread(series, 4).first()["std"] == pytest.approx(np.std(range(4), ddof=1))


def test_band_limits(spark):
    stats = spark.createDataFrame([(1, 2.0, 0.5)], "day int, mean double, std double")
    row = daily.band(stats, 3).first()
    assert (row["lower"], row["upper"]) == (0.5, 3.5)
    for multiple in (0.01, 11):
        with pytest.raises(ValueError):
            daily.band(stats, multiple)


def test_dense_series_fills_active_days_only(spark, rows):
    series = _daily(spark, (1, "A", 2), (3, "B", 1), (4, "C", 1))
    cells = daily.dense_series(series, _picked(spark, "A", "B"), 1, 4)
    expected = {(1, "A", 2), (1, "B", 0), (3, "A", 0), (3, "B", 1), (4, "A", 0), (4, "B", 0)}
    assert rows(cells, "day", "entity", "value") == expected
    averaged = daily.dense_series(series, _picked(spark, "A"), 1, 1, population=4)
    assert rows(averaged, "day", "entity", "value") == {(1, "A", 2.0), (1, "Average", 0.5)}
    stats = daily.daily_spread(series, 4, 1, 1)
    plain = daily.dense_series(series, _picked(spark, "A"), 1, 1)
    assert rows(daily.with_average(plain, stats), "day", "entity", "value") == {(1, "A", 2.0), (1, "Average", 0.5)}
    assert rows(daily.without_average(averaged), "entity") == {("A",)}


def test_wide_to_long(spark, rows):
    wide = spark.createDataFrame([(1, 2, 3, 9), (2, 4, 5, 9)], "day int, A long, B long, Average long")
    assert rows(daily.wide_to_long(wide, "n", 2, 2, False), "day", "entity", "n") == {(2, "A", 4), (2, "B", 5)}
    assert daily.wide_to_long(wide, "n", 1, 2).count() == 6


def test_totals_keep_quiet_days_and_entities(spark, rows):
    series = _daily(spark, (1, "A", 2), (2, "C", 7), (3, "B", 1), (3, "A", 1))
    picked = _picked(spark, "A", "B", "D")
    assert rows(daily.day_totals(series, picked), "day", "value") == {(1, 2), (2, 0), (3, 2)}
    assert rows(daily.entity_totals(series, picked, 1, 2), "entity", "total") == {("A", 2), ("B", 0), ("D", 0)}


def _mentions(spark, *mention_rows):
    return spark.createDataFrame(
        list(mention_rows), "message_id long, day int, entity string, n long, lead boolean, compound double"
    )


def test_sentiment_counts_once_and_zero_fills(spark, rows):
    found = _mentions(spark, (1, 1, "A", 3, True, 0.6), (2, 1, "B", 1, True, 0.2))
    assert rows(sentiment.daily_sentiment(found), "entity", "sentiment") == {("A", 0.6), ("B", 0.2)}
    assert rows(sentiment.daily_sentiment(found, "zerofill"), "entity", "sentiment") == {("A", 0.3), ("B", 0.1)}
    with pytest.raises(ValueError):
        sentiment.daily_sentiment(found, "other")


def test_messages_without_a_score_do_not_count(spark, rows):
    found = _mentions(spark, (1, 1, "A", 1, True, 0.6), (2, 1, "A", 1, True, None), (2, 1, "B", 1, False, None))
    for mode in ("mentioned", "zerofill"):
        assert rows(sentiment.daily_sentiment(found, mode), "entity", "sentiment") == {("A", 0.6), ("B", 0.0)}


def test_mean_of_daily_means(spark, rows):
    found = sentiment.daily_sentiment(_mentions(spark, (1, 1, "A", 1, True, 0.5), (2, 2, "B", 1, True, 0.1)))
    assert rows(sentiment.mean_sentiment(found, _picked(spark, "A")), "entity", "sentiment") == {("A", 0.25)}
    by_day = sentiment.day_mean_sentiment(found, _picked(spark, "A", "B"))
    assert rows(by_day, "day", "value") == {(1, 0.25), (2, 0.05)}


def test_lexicon_sentiment(spark):
    texts = ["good day", "not good", "very bad", "", "plain words", None]
    messages = spark.createDataFrame(list(enumerate(texts)), "message_id long, body string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "token string, valence double")
    scores = sentiment.lexicon_sentiment(messages, lexicon, ["not"], {"very": 0.3})
    got = {r["message_id"]: r for r in scores.collect()}
    norm = lambda s: s / math.sqrt(s * s + 15)
    expected = [norm(2), norm(2 * -0.74), norm(-2.3), 0, 0, 0]
    assert [got[i]["compound"] for i in range(6)] == pytest.approx(expected)
    assert (got[0]["pos"], got[0]["neu"], got[0]["neg"]) == pytest.approx((0.75, 0.25, 0))
    assert (got[3]["pos"], got[3]["neu"], got[4]["neu"]) == (0, 0, 1)


def _events(spark):
    return spark.createDataFrame(
        [(1, "Exits", "x", "B"), (1, "Exits", "x", "A"), (1, "Exits", "x", "A"), (1, "Dates", "d", "A"), (5, "Dates", "e", "C")],
        "day int, type string, summary string, entity string",
    )


def test_timeline(spark):
    events = _events(spark)
    grouped = {(r["day"], r["type"]): (r["entities"], r["rows"]) for r in timeline.event_entities(events).collect()}
    assert grouped == {(1, "Exits"): (["A", "B"], [2, 1]), (1, "Dates"): (["A"], [1]), (5, "Dates"): (["C"], [1])}
    only_b = timeline.event_entities(events, _picked(spark, "B"), 1, 3).collect()
    assert [(r["type"], r["entities"]) for r in only_b] == [("Exits", ["B"])]
    digest = {r["day"]: (r["types"], r["summaries"]) for r in timeline.day_digest(events, 1, 2).collect()}
    assert digest == {1: ("Dates, Exits", "d\nx"), 2: (None, None)}
    assert timeline.day_digest_rows(events, 1, 2).count() == 3
    days = spark.createDataFrame([(1, 4), (2, 0)], "day int, value long")
    joined = timeline.day_events(days, events).collect()
    assert sorted((r["day"], r["value"], r["type"] or "") for r in joined) == [(1, 4, "Dates"), (1, 4, "Exits"), (2, 0, "")]
    assert timeline.event_type_days(events).count() == 3
    assert [tuple(r) for r in timeline.event_markers(events, ["Exits"], 1, 4).collect()] == [("Exits", 1, "x", 3)]


def _values(spark, **by_day):
    return spark.createDataFrame([(int(d[1:]), float(v)) for d, v in by_day.items()], "day int, value double")


def test_blocks(spark):
    values = _values(spark, d1=1, d2=2, d5=3, d6=4, d9=5)
    ordinal = sorted(tuple(r) for r in moments.ordinal_blocks(values, 2).collect())
    assert ordinal == [(0, [1, 2], 3.0), (1, [5, 6], 7.0), (2, [9], 5.0)]
    width = sorted(tuple(r) for r in moments.equal_width_blocks(values, 2).collect())
    assert width == [(0, [1, 2, 5], 2.0), (1, [6, 9], 4.5)]
    assert [r["days"] for r in moments.equal_width_blocks(_values(spark, d4=1), 2).collect()] == [[4]]


@pytest.mark.parametrize("seed", range(4))
def test_equal_width_blocks_equal_pandas_cut(spark, seed):
    draw = np.random.default_rng(seed)
    days = sorted(draw.choice(np.arange(1, 60), 25, replace=False).tolist())
    values = spark.createDataFrame([(d, 1.0) for d in days], "day int, value double")
    size = seed + 2
    expected = pd.cut(pd.Series(days), len(days) // size, labels=False)
    blocks = {d: r["block"] for r in moments.equal_width_blocks(values, size).collect() for d in r["days"]}
    assert [blocks[d] for d in days] == expected.tolist()


def test_extremes_need_three_blocks(spark):
    blocks = moments.ordinal_blocks(_values(spark, d1=1, d2=5, d3=5, d4=0), 1)
    got = {(r["side"], r["rank"]): r["days"] for r in moments.extremes(blocks).collect()}
    assert got == {
        ("high", 1): [2], ("high", 2): [3], ("high", 3): [1], ("low", 1): [4], ("low", 2): [1], ("low", 3): [2],
    }
    assert moments.extremes(moments.ordinal_blocks(_values(spark, d1=1, d2=2), 1)).count() == 0


def test_moment_details(spark):
    blocks = moments.ordinal_blocks(_values(spark, d1=1.234, d2=5, d5=7, d6=8, d8=9), 2)
    found = {(r["side"], r["rank"]): r for r in moments.moment_details(moments.extremes(blocks), _events(spark)).collect()}
    top = found[("high", 1)]
    assert (top["day_range"], top["value"], top["types"], top["summaries"], top["entities"]) == (
        "Days 5 to 6", 15.0, ["Dates"], "* e", ["C"],
    )
    assert (found[("high", 2)]["day_range"], found[("high", 2)]["summaries"]) == ("Day 8", "No main events happened")
    assert (found[("low", 1)]["value"], found[("low", 1)]["summaries"]) == (6.23, "* d\n* x")


def test_post_exit(spark, rows):
    people = _roster(spark, ("A", 1, 19, "x", 1), ("A", 27, 58, "x", None), ("B", 1, 57, "x", 1), ("C", 1, None, None, 1))
    exits = roster.last_exits(people)
    series = _daily(spark, (59, "C", 3), (60, "A", 4), (60, "B", 2))
    own = postexit.post_exit_daily(series, exits, _picked(spark, "A"))
    assert rows(own, "entity", "offset", "value") == {("A", 1, 0), ("A", 2, 4)}
    stats = postexit.post_exit_spread(series, exits, _picked(spark, "A", "B", "C"))
    assert rows(stats, "offset", "mean") == {(1, 0.0), (2, 2.0), (3, 2.0)}
    both = postexit.post_exit_with_average(series, exits, _picked(spark, "A"), _picked(spark, "A", "B", "C"))
    assert rows(both, "entity", "offset", "value") == {
        ("A", 1, 0.0), ("A", 2, 4.0), ("Average", 1, 0.0), ("Average", 2, 2.0), ("Average", 3, 2.0),
    }
    assert rows(postexit.post_exit_totals(own), "entity", "total") == {("A", 4)}


def test_codes_are_dense_and_reversible(spark, rows):
    names = [(f"E{i:03}", 1 if i % 3 else i) for i in range(200)]
    people = _roster(spark, *[(n, d, None, None, d) for n, d in names], ("E001", 99, None, None, 99))
    coded = codes.entity_codes(people)
    expected = {n: i for i, (d, n) in enumerate(sorted((d, n) for n, d in names))}
    assert {r["entity"]: r["code"] for r in coded.collect()} == expected
    pairs = spark.createDataFrame([("E001", "E150", 3), ("E150", "E001", 3)], "x string, y string, weight long")
    text = codes.encode_pairs(pairs, coded)
    assert {r["pair"] for r in text.collect()} == {
        f"({expected[a]}, {expected[b]})" for a, b in (("E001", "E150"), ("E150", "E001"))
    }
    assert rows(codes.decode_pairs(text, coded), "x", "y", "weight") == rows(pairs, "x", "y", "weight")
