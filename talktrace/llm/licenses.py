"""Fuzzy search for short license notices.

A notice with at most e errors, cut in e + 1 pieces, has a piece without error. So the exact pieces of all
notices are searched together, and only around them the regex library's bounded-error matching looks
for the notice, checks its edits and reports the span. The best match is taken first, then the best in what is left.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# Exact phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Short notices searched with errors; one error for every ERROR_CHARS characters.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the apache license version 2": "apache-2",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}
ERROR_CHARS = 9
JOINED = 4  # windows of a notice that touch are searched as one up to this many times its length
_LETTER = regex.compile(r"\w")
_KEPT = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normalized(text: str | None) -> list[bytes]:
    """Words: runs of digits, letters in lower case, and characters beyond ASCII."""
    return (text or "").encode().translate(_KEPT).split()


class NoticeSearch:
    """Finds phrases and notices in a text's normalized form (one character for each byte)."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, error_chars: int = ERROR_CHARS):
        self.base, self.notices, self.seeds = base, [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (phrase, label) in enumerate(notices.items()):
            errors = len(phrase) // error_chars
            bounds = [round(len(phrase) * i / (errors + 1)) for i in range(errors + 2)]
            for a, b in zip(bounds, bounds[1:]):
                pieces.setdefault(phrase[a:b], []).append((number, a))
            pattern = regex.compile(rf"(?b)\b(?:{regex.escape(phrase)}){{e<={errors}}}\b")
            self.notices.append((label, len(phrase), errors, pattern))
        for piece, places in pieces.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def exact(self, joined: str) -> list[tuple[int, int, str]]:
        """(start, end, label) of every place of a base phrase."""
        found = []
        padded = f" {joined} "
        for phrase, label in self.base.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                found.append((at, at + len(phrase), label))
                at = padded.find(f" {phrase} ", at + 1)
        return found

    def _windows(self, joined: str) -> Iterator[tuple[int, int, int]]:
        """(notice, start, end) of the places where a notice can be: each lies whole in one. Their length is bounded."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.seeds.iter(joined):
            for number, offset in places:
                _, size, errors, _ = self.notices[number]
                start = end + 1 - length - offset - errors
                stop = start + size + 2 * errors
                own = windows.setdefault(number, [])
                if own and start <= own[-1][1] and max(own[-1][1], stop) - min(own[-1][0], start) <= JOINED * size:
                    own[-1][1] = max(own[-1][1], stop)
                    own[-1][0] = min(own[-1][0], start)
                else:
                    own.append([start, stop])
        for number, spans in windows.items():
            for start, end in spans:
                yield number, max(0, start), min(len(joined), end)

    def fuzzy(self, joined: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, share of characters without error) of notices; of overlapping ones the best.

        A pattern gives the best match of a window only. So the best match of all windows is taken, and what it
        leaves free of its own window, and of those whose match it overlaps, is searched again, until no window has a match.
        """
        queue: list[tuple] = []

        def look(number: int, start: int, end: int) -> None:
            while start < end < len(joined) and _LETTER.match(joined[end - 1]) and _LETTER.match(joined[end]):
                end -= 1  # the pattern takes the window's end for a word's
            label, size, _, pattern = self.notices[number]
            match = pattern.search(joined, start, end) if start < end else None
            if match:
                score = 1 - sum(match.fuzzy_counts) / size
                heappush(queue, (-score, match.start(), -match.end(), label, number, start, end))

        for window in self._windows(joined):
            look(*window)
        best: list[tuple[int, int, str, float]] = []  # in order, without overlap
        while queue:
            score, start, stop, label, number, low, high = heappop(queue)
            stop = -stop
            at = bisect_left(best, (start,))
            if (at == len(best) or stop <= best[at][0]) and (not at or best[at - 1][1] <= start):
                best.insert(at, (start, stop, label, -score))
            first = bisect_left(best, (low,))
            if first and best[first - 1][1] > low:
                first -= 1
            for begin, end, *_ in best[first : bisect_left(best, (high,))]:
                look(number, low, begin)
                low = max(low, end)
            look(number, low, high)
        return best


_search: NoticeSearch | None = None


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (of words) of a whole text."""
    global _search
    if _search is None:
        _search = NoticeSearch()
    words = normalized(text)
    joined = b" ".join(words).decode("latin-1")
    exact, fuzzy = _search.exact(joined), _search.fuzzy(joined)
    spaces = np.flatnonzero(np.frombuffer(b" ".join(words), dtype=np.uint8) == 32)

    def word_at(place: int) -> int:
        return int(np.searchsorted(spaces, place))

    starts = [word_at(at) for at, _, _ in exact]
    spans = [f"{label}:{word_at(a)}:{word_at(b) + 1}" for a, b, label, _ in fuzzy]
    base = {label for _, _, label in exact}
    score = 1.0 if exact else max((s for *_, s in fuzzy), default=0.0)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {label for _, _, label, _ in fuzzy})), score, ",".join(spans))


_TYPES = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
          "labels": "string", "score": "double", "spans": "string"}


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([scan(t) for t in texts], columns=list(_TYPES))
    return rows.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and what `scan` finds, for every row of `docs` (doc_id, text; more columns are ignored).

    A null text is empty: no words, no labels, score 0. Repeated rows are scanned each. An empty table gives no rows.
    """
    found = F.pandas_udf(_scan, ", ".join(f"{name} {kind}" for name, kind in _TYPES.items()))
    return docs.select("doc_id", found("text").alias("found")).select("doc_id", "found.*")
