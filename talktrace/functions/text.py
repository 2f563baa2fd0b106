"""Regular expressions for alias dictionaries and tokens.

Word characters are spelled out (letters, digits, underscore of any script) instead of relying on
`\\b` and `\\w`, whose reach changed between Java releases: the result must not depend on the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# What counts as a word character and as white space.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}"

_WORD = f"[{WORD_CLASS}]"
NOTHING = "(?!)"  # matches nowhere
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def prefix_tree(words: Iterable[str], after_each: str = "") -> str:
    """One expression for all words that prefers the longest, branching once per shared prefix.

    `after_each` is an expression that may follow every character.

    The cost per text position then depends on how many letters match, not on how many words
    there are, which is what keeps one scan affordable with a large dictionary.
    """
    root: dict = {}
    for word in words:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    nodes = [root]
    for node in nodes:
        nodes.extend(child for c, child in node.items() if c)
    done: dict[int, str] = {}
    for node in reversed(nodes):  # children before their parents, without recursion over letters
        leaves = [c for c, child in node.items() if c and child.keys() == {""}]
        parts = [
            re.escape(c) + after_each + done.pop(id(child))
            for c, child in node.items()
            if c and c not in leaves
        ]
        if len(leaves) == 1:
            parts.append(re.escape(leaves[0]) + after_each)
        elif leaves:
            parts.append("[" + "".join(map(re.escape, leaves)) + "]" + after_each)
        body = "" if not parts else parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        done[id(node)] = body + "?" if body and "" in node else body
    return done[id(root)]


def _starts_with_any(words: Sequence[str]) -> str:
    """A look-ahead that discards most positions before any word is tried."""
    return "(?=[" + "".join(map(re.escape, sorted({w[0] for w in words}))) + "])"


def _edges(words: Sequence[str]) -> tuple[str, str]:
    """Boundary tests before and after; one look-around suffices next to a word character."""
    before = f"(?<!{_WORD})" if all(_is_word(w[0]) for w in words) else BOUNDARY
    after = f"(?!{_WORD})" if all(_is_word(w[-1]) for w in words) else BOUNDARY
    return before, after


def _reachable(words: Sequence[str]) -> list[str]:
    """Words that can still match when alternatives are tried in order: none has an earlier prefix."""
    kept: list[str] = []
    seen: set[str] = set()
    for word in words:
        if not any(word[:n] in seen for n in range(1, len(word) + 1)):
            seen.add(word)
            kept.append(word)
    return kept


def whole_word_pattern(words: Sequence[str]) -> str:
    """Any of the words as a whole word; of several at one position, the longest."""
    before, after = _edges(words)
    return _starts_with_any(words) + before + prefix_tree(words) + after


def outer_edge_pattern(groups: Sequence[Sequence[str]]) -> str:
    """Ordered alternatives where only the first group's start and the last group's end are guarded.

    All other words may match inside longer words, and an earlier word hides a later one that
    begins with it. Within a group without a guard behind it, leaving out the hidden words makes
    "first in order" and "longest" the same, so those groups can share a prefix tree.
    """
    everything = [w for g in groups for w in g]
    first, last = groups[0], groups[-1]
    ordered_last = "(?:" + "|".join(map(re.escape, last)) + ")" + _edges(last)[1]
    if len(groups) == 1:
        return _starts_with_any(everything) + _edges(first)[0] + ordered_last
    middle = _reachable([w for g in groups[1:-1] for w in g])
    options = [_edges(first)[0] + prefix_tree(_reachable(first))]
    if middle:
        options.append(prefix_tree(middle))
    options.append(ordered_last)
    return _starts_with_any(everything) + "(?:" + "|".join(options) + ")"


def scattered_token_pattern(words: Sequence[str]) -> str:
    """White-space separated tokens that are one of the words once their punctuation is taken out.

    Finds in one pass what `plain_tokens` and a comparison find by rewriting and splitting the whole
    text. The punctuation run is possessive: it has nothing in common with what follows it.
    """
    punctuation = f"[^{WORD_CLASS}{SPACE_CLASS}]*+"
    edge = f"[^{SPACE_CLASS}]"
    return f"(?<!{edge}){punctuation}{prefix_tree(words, punctuation)}(?!{edge})"


def without_punctuation(token: Column) -> Column:
    return F.regexp_replace(token, f"[^{WORD_CLASS}{SPACE_CLASS}]", "")


def is_plain_word(word: str) -> bool:
    """Whether a word can be a token of punctuation-free text at all."""
    return bool(word) and all(map(_is_word, word))


def runs(body: Column) -> Column:
    """The text as alternating runs of word characters and of others."""
    return F.regexp_extract_all(body, F.lit(f"{_WORD}+|[^{WORD_CLASS}]+"), F.lit(0))


def starts_as_word(value: Column) -> Column:
    return F.regexp_like(value, F.lit(f"^{_WORD}"))


def ends_as_word(value: Column) -> Column:
    return F.regexp_like(value, F.lit(f"{_WORD}$"))


def has_token(body: Column) -> Column:
    """Whether anything is left after punctuation is taken out."""
    return F.coalesce(F.regexp_like(body, F.lit(_WORD)), F.lit(False))


def plain_tokens(body: Column) -> Column:
    """White-space separated tokens after all punctuation is taken out."""
    return F.filter(F.split(without_punctuation(body), f"[{SPACE_CLASS}]+"), lambda t: t != "")


def words(body: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(body, F.lit(f"{_WORD}+"), F.lit(0))
