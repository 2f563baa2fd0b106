"""Stored mentions and edges."""

from __future__ import annotations

import pytest

from talktrace.operators import daily, sentiment
from talktrace.operators.aliases import AliasBook
from talktrace.plans.stored import StoredAnalytics
from talktrace.sources.store import Materialised

BOOK = AliasBook((("ann", "Ann"), ("bob", "Bob"), ("cy", "Cy")))


def test_texts_are_only_read_when_forced(spark, rows):
    def analytics(*bodies):
        data = [(i, i % 2 + 1, b, 0.5) for i, b in enumerate(bodies)]
        messages = spark.createDataFrame(data, "message_id long, day int, body string, compound double")
        return StoredAnalytics(Materialised(spark, "test_stored"), messages, BOOK)

    first = analytics("ann and bob", "nobody", "ann ann cy")
    assert rows(first.edges_daily(), "day", "x", "y", "weight") == {
        (1, "Ann", "Bob", 1), (1, "Bob", "Ann", 1), (1, "Ann", "Cy", 1), (1, "Cy", "Ann", 1),
    }
    assert rows(daily.daily_mentions(first.mention_rows()), "day", "entity", "n") == {
        (1, "Ann", 3), (1, "Bob", 1), (1, "Cy", 1),
    }
    scores = sentiment.daily_sentiment(first.mention_rows(), "zerofill")
    assert rows(scores, "entity", "sentiment") == {("Ann", 0.5), ("Bob", 0.25), ("Cy", 0.25)}

    second = analytics("bob cy")
    assert rows(second.mention_sets(), "message_id") == {(0,), (2,)}
    assert second.edges_daily(force=True).count() == 4
    assert rows(second.edges_daily(force_all=True), "x", "y") == {("Bob", "Cy"), ("Cy", "Bob")}
    held = second.mention_sets(hold=True)
    assert second.mention_sets(hold=True) is held


@pytest.mark.parametrize("entries", [(("", "A"),), (("a", "A"), ("a", "B"))])
def test_unusable_dictionaries_are_refused(entries):
    with pytest.raises(ValueError):
        AliasBook(entries)


def test_plans_on_the_version_before_still_run(spark, rows):
    kept = Materialised(spark, "test_versions")

    def build(value):
        return lambda: spark.createDataFrame([(1, value)], "day int, n int")

    before = kept.replace("t", build(1))
    after = kept.replace("t", build(2))
    assert rows(before, "n") == {(1,)} and rows(after, "n") == {(2,)}
    kept.replace("t", build(3))
    assert len(kept.versions("t")) == 2
    assert rows(after, "n") == {(2,)} and rows(kept.load("t", build(4)), "n") == {(3,)}


def test_dictionaries_too_large_for_a_plan_are_refused(spark, rows, monkeypatch):
    monkeypatch.setattr("talktrace.operators.aliases.MOST_IN_PLAN", 2)
    table = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("c", "C", 3)], "alias string, entity string, alias_order int")
    assert len(AliasBook.of(table.where("alias < 'c'"))) == 2
    with pytest.raises(ValueError, match="more than 2"):
        AliasBook.of(table)
