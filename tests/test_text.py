"""Alias patterns, mention counts and tokens."""

from __future__ import annotations

import re
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from talktrace.functions import text
from talktrace.operators import aliases, mentions
from talktrace.operators.aliases import AliasBook


def book(**entities):
    """Entity name to aliases, in dictionary order."""
    return AliasBook(tuple((a, e) for e in sorted(entities) for a in entities[e]))


def frame(spark, *bodies):
    data = [(i, 1, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, "message_id long, day int, body string")


def counts(spark, names, *bodies, boundary="word"):
    scanned = mentions.scan_mentions(frame(spark, *bodies), names, boundary)
    found = mentions.mention_rows(scanned).select("message_id", "entity", "n").collect()
    return {(r[0], r[1]): r[2] for r in found}


SAMPLE = ("Mira won again", "Oskar met Pavel there", "Pavel, Mira: where is Piet now")
NAMES = book(T=["Mira"], R=["Oskar"], J=["Pavel", "Piet"])


@pytest.mark.parametrize("boundary", ["word", "outer"])
def test_counts_by_entity_and_silent_messages_are_absent(spark, boundary):
    found = counts(spark, NAMES, *SAMPLE, "nobody", boundary=boundary)
    assert found == {(0, "T"): 1, (1, "R"): 1, (1, "J"): 1, (2, "T"): 1, (2, "J"): 2}


def test_whole_tokens_keep_silent_messages(spark):
    got = mentions.count_whole_tokens(frame(spark, "Mi'ra, (Mira)!", "nobody", "", "?!", None), NAMES)
    assert {tuple(r) for r in got.select("message_id", "entity", "n").collect()} == {(0, "T", 2), (1, None, 0)}


def test_whole_tokens_with_joined_dictionary_agree(spark, monkeypatch):
    bodies = frame(spark, *SAMPLE, "P-i-e-t, Mira Mira", "nobody", "!!")
    table = spark.createDataFrame(list(NAMES.entries), "alias string, entity string").withColumn(
        "alias_order", F.lit(0)
    )
    columns = ["message_id", "entity", "n"]
    small = {tuple(r) for r in mentions.count_whole_tokens(bodies, table).select(columns).collect()}
    monkeypatch.setattr(mentions, "IN_ROW_ALIASES", 1)
    joined = {tuple(r) for r in mentions.count_whole_tokens(bodies, table).select(columns).collect()}
    assert small == joined and (3, "J", 1) in small and (3, "T", 2) in small


def _both_sides(monkeypatch, scan):
    """Sorted rows below and above the switch between a literal map and a join."""
    small = sorted(map(repr, scan().collect()))
    with monkeypatch.context() as patch:
        patch.setattr(mentions, "IN_ROW_ALIASES", 0)
        large = sorted(map(repr, scan().collect()))
    return small, large


TEXTS = (*SAMPLE, "nobody", "", "?!", "...", None, "O'Neil, O'Neil's O'Neilx", "A.B. and C+ C++ D", "an an old an old hat", "Mira")
DICTIONARIES = {
    "names": list(NAMES.entries),
    "repeated": [("Mira", "X"), ("Mira", "T"), ("Piet", "J"), ("Piet", "J")],
    "punctuation": [("O'Neil", "N"), ("C+", "C"), ("A.B", "A"), (".", "P")],
    "phrases": [("an", "1"), ("an old", "2"), ("old hat", "3"), ("hat", "4"), ("an old an", "5")],
    "empty": [],
    "blank": [("", "E"), (None, "N")],
}


@pytest.mark.parametrize("name", sorted(DICTIONARIES))
def test_rows_do_not_depend_on_the_dictionary_size(spark, monkeypatch, name):
    table = spark.createDataFrame([(a, e, i) for i, (a, e) in enumerate(DICTIONARIES[name])], "alias string, entity string, alias_order int")
    bodies = frame(spark, *TEXTS)
    for boundary in ("word", "outer"):
        small, large = _both_sides(monkeypatch, lambda: mentions.scan_mentions(bodies, table, boundary))
        assert small == large and len(small) == len(TEXTS)
    small, large = _both_sides(monkeypatch, lambda: mentions.count_whole_tokens(bodies, table))
    assert small == large
    silent = {r.message_id for r in mentions.count_whole_tokens(bodies, table).collect()}
    assert silent == {i for i, t in enumerate(TEXTS) if t and re.search(r"\w", t)}


@pytest.mark.parametrize("chunk", [1, 1 << 19])
def test_a_joined_dictionary_gives_the_rows_of_one_looked_up(spark, monkeypatch, chunk):
    """Rows that share their keys are one message; long texts and messages are handled in parts."""
    monkeypatch.setattr(mentions, "IN_ROW_ALIASES", 0)
    monkeypatch.setattr(mentions, "CHUNK_PARTS", chunk)
    data = [(i, 1, t) for i, t in enumerate(TEXTS)] + [(0, 1, TEXTS[0]), (None, None, "an old an"), (None, None, "old hat, Mira"), (3, 2, "an old hat")]
    bodies = spark.createDataFrame(data, "message_id long, day int, body string")
    for entries in DICTIONARIES.values():
        table = spark.createDataFrame([(a, e, i) for i, (a, e) in enumerate(entries)], "alias string, entity string, alias_order int")
        for scan in (mentions.scan_mentions, mentions.count_whole_tokens):
            held = sorted(map(repr, scan(bodies, table).collect()))
            with monkeypatch.context() as patch:
                patch.setattr(aliases, "MOST_IN_PLAN", 0)
                joined = sorted(map(repr, scan(bodies, table).collect()))
            assert held == joined


@pytest.mark.parametrize("most", [0, 50_000])
def test_a_long_text_takes_time_in_proportion(spark, monkeypatch, most):
    """Work and memory used to grow with the square of a text's words."""
    monkeypatch.setattr(mentions, "IN_ROW_ALIASES", 0)
    monkeypatch.setattr(aliases, "MOST_IN_PLAN", most)
    table = spark.createDataFrame([(f"w{i}", f"E{i % 7}", i) for i in range(0, 30_000, 2)], "alias string, entity string, alias_order int")
    body = frame(spark, " ".join(f"w{i}" for i in range(60_000)))
    for scan in (lambda: mentions.mention_rows(mentions.scan_mentions(body, table)), lambda: mentions.count_whole_tokens(body, table)):
        start = time.monotonic()
        assert {r.entity: r.n for r in scan().collect()} == Counter(f"E{i % 7}" for i in range(0, 30_000, 2))
        assert time.monotonic() - start < 30


def test_book_and_table_agree(spark, monkeypatch):
    monkeypatch.setattr(mentions, "IN_ROW_ALIASES", 0)
    table = spark.createDataFrame([(a, e, i) for i, (a, e) in enumerate(NAMES.entries)], "alias string, entity string, alias_order int")
    assert counts(spark, table, *SAMPLE, "nobody") == counts(spark, NAMES, *SAMPLE, "nobody")


def test_boundary_modes_differ_inside_words(spark):
    names = book(A=["Ivo"], M=["Lu"], Z=["Uwe"])
    assert counts(spark, names, "Lumen", boundary="outer") == {(0, "M"): 1}
    assert counts(spark, names, "Lumen", boundary="word") == {}
    # Only the first entity's start and the last entity's end are guarded.
    assert counts(spark, names, "xIvo Ivox xUwe Uwex", boundary="outer") == {(0, "A"): 1, (0, "Z"): 1}


def test_earlier_prefix_hides_the_longer_alias_only_in_outer_mode(spark):
    names = book(A=["Ivo"], B=["Kar"], C=["Karin"], Z=["Uwe"])
    assert counts(spark, names, "Karin and Kar", boundary="outer") == {(0, "B"): 2}
    assert counts(spark, names, "Karin and Kar", boundary="word") == {(0, "B"): 1, (0, "C"): 1}


def test_aliases_of_several_words_and_metacharacters(spark):
    names = book(E=["Ella", "OG Ella"], S=["A.B", "C+"])
    assert counts(spark, names, "OG Ella, Ella. AxB A.B") == {(0, "E"): 2, (0, "S"): 1}


def test_letters_of_any_script_are_word_characters(spark):
    names = book(A=["An"], I=["In"])
    assert counts(spark, names, "éAn Iné In_ An-In") == {(0, "A"): 1, (0, "I"): 1}


def test_unknown_boundary_is_refused():
    with pytest.raises(ValueError):
        NAMES.pattern("loose")


def test_aliases_may_be_long_and_nested(spark):
    long = "x" * 1_500
    names = book(L=[long], N=["y" * n for n in range(1, 300)])
    assert counts(spark, names, f"{long} {'y' * 299} z") == {(0, "L"): 1, (0, "N"): 1}


def test_mentioned_lists_by_count_then_name(spark):
    names = book(T=["t"], R=["r"], J=["j"], A=["a"])
    texts = ["t t t j", "t t t r r j", "t t t r r j " + "a " * 11, "r j"]
    sets = mentions.mention_sets(mentions.scan_mentions(frame(spark, *texts), names))
    listed = {r["message_id"]: r["entities"] for r in mentions.mentioned_lists(sets).collect()}
    assert listed == {0: ["T", "J"], 1: ["T", "R", "J"], 2: ["A", "T", "R", "J"], 3: ["J", "R"]}
    shorter = mentions.mentioned_lists(sets, exclude=names.entities[-1]).collect()
    assert {r["message_id"]: r["entities"] for r in shorter}[0] == ["J"]


def _brute_force(groups, body, boundary):
    """Greedy left-to-right matching, written down as the rule says."""
    def word(i):
        return 0 <= i < len(body) and (body[i].isalnum() or body[i] == "_")

    def edge(i):
        return word(i - 1) != word(i)

    order = [(a, g) for g, names in enumerate(groups) for a in names]
    if boundary == "word":
        order.sort(key=lambda p: -len(p[0]))
    hits, i = [], 0
    while i < len(body):
        for alias, g in order:
            end = i + len(alias)
            start_ok = edge(i) if boundary == "word" or g == 0 else True
            end_ok = edge(end) if boundary == "word" or g == len(groups) - 1 else True
            if body.startswith(alias, i) and start_ok and end_ok:
                hits.append(alias)
                i = end
                break
        else:
            i += 1
    return hits


_alias = st.text("aбA b", min_size=1, max_size=4)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(_alias, min_size=1, max_size=7, unique=True),
    st.lists(st.text("aбA b-", max_size=14), min_size=1, max_size=12),
    st.integers(1, 4),
)
def test_patterns_equal_brute_force(spark, names, bodies, n_groups):
    groups = [g for g in (names[i::n_groups] for i in range(n_groups)) if g]
    entries = AliasBook(tuple((a, str(i)) for i, g in enumerate(groups) for a in g))
    data = spark.createDataFrame([(b,) for b in bodies], "body string")
    table = mentions._whole_words_by_join(
        data.select(F.monotonically_increasing_id().alias("message_id"), "body"), entries.table(spark), ["message_id"]
    )
    joined = [r.found for r in table.orderBy("message_id").collect()]
    owner = dict(entries.entries)
    for body, found in zip(bodies, joined):
        hits = [owner[h] for h in _brute_force(groups, body, "word")]
        assert [(f.entity, f.n) for f in found] == sorted((e, hits.count(e)) for e in set(hits))
    for boundary in ("word", "outer"):
        hits = F.regexp_extract_all("body", F.lit(entries.pattern(boundary)), F.lit(0))
        assert [r[0] for r in data.select(hits).collect()] == [
            _brute_force(groups, b, boundary) for b in bodies
        ]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text("abк", min_size=1, max_size=3), min_size=1, max_size=6, unique=True),
    st.lists(st.text("abк -!\n", max_size=14), min_size=1, max_size=12),
)
def test_scattered_tokens_equal_rewriting_and_splitting(spark, names, bodies):
    data = spark.createDataFrame([(b,) for b in bodies], "body string")
    pattern = F.lit(text.scattered_token_pattern(names))
    one_pass = F.transform(F.regexp_extract_all("body", pattern, F.lit(0)), text.without_punctuation)
    for body, (got, has) in zip(bodies, data.select(one_pass, text.has_token(F.col("body"))).collect()):
        tokens = re.sub(r"[^\w\s]", "", body).split()
        assert got == [t for t in tokens if t in names]
        assert has == bool(tokens)


def test_alias_dictionary_keeps_first_place_and_last_entity(spark):
    wide = spark.createDataFrame(
        [(0, "Ann Lee", "Ann", "Al"), (1, "Bob Ray", "Bob", None), (2, "Cy Fox", "Ann", "Bob")],
        "row_no int, entity string, a string, b string",
    )
    built = aliases.alias_dictionary(wide, "entity", ["a", "b"], "row_no")
    found = {r["alias"]: (r["entity"], tuple(r["alias_order"])) for r in built.collect()}
    assert found == {"Ann": ("Cy Fox", (0, 0)), "Bob": ("Cy Fox", (0, 1)), "Al": ("Ann Lee", (1, 0))}
    lists = {r["entity"]: r["aliases"] for r in aliases.alias_lists(built).collect()}
    assert lists == {"Cy Fox": ["Ann", "Bob"], "Ann Lee": ["Al"]}
    searched = {r["alias"]: r["entity"] for r in aliases.search_dictionary(wide, "entity", "row_no", built).collect()}
    assert searched == {"Ann": "Cy Fox", "Bob": "Cy Fox", "Cy": "Cy Fox", "Al": "Ann Lee"}
