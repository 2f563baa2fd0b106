"""Quality rules with verdicts by host.

Rules are measured on every document. Their failures are summed by host, and each rate is shrunk towards
the rates of all hosts by a beta prior fitted to them (by moments), so a host of few documents is not
judged by those alone. Hosts whose shrunk rate is above a limit are rejected, and the verdict is joined
back to their documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stored

LEAST_WORDS = 50
REPEATED_PERCENT = 50
SYMBOL_PERCENT = 10
WORD_CHARS = (2, 20)
REJECT_ABOVE = 0.5
STRENGTH = (1.0, 10_000.0)
_SPACE, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeated": f"100 * n_repeat_words > {REPEATED_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {SYMBOL_PERCENT} * n_words",
    "lengths": f"word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words",
}
BASE = ("short", "repeated")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)
    _, place, counts = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[place] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + n - 2] |= often
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t) for t in texts], columns=list(MEASURES), dtype=np.int64)


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, rejected: by the highest shrunk failure rate of its rules; `measured` has host and the measures."""
    failures = {rule: F.sum(F.expr(f"CAST({sql} AS BIGINT)")) for rule, sql in RULES.items()}
    hosts = stored(measured.groupBy("host").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in failures.items()]))
    moments = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{r}_{k}") for r in RULES for k, f in (("mean", F.avg), ("var", F.var_pop))])
    fitted = moments.first().asDict()  # two numbers for each rule
    shrunk = []
    for rule in RULES:
        mean, variance = fitted[f"{rule}_mean"] or 0.0, fitted[f"{rule}_var"] or 0.0
        strength = min(max(mean * (1 - mean) / variance - 1 if variance else STRENGTH[1], STRENGTH[0]), STRENGTH[1])
        shrunk.append((F.col(rule) + mean * strength) / (F.col("n") + strength))
    return stored(hosts.select("host", (F.greatest(*shrunk) > REJECT_ABOVE).alias("rejected")))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed and kept, for every row of `docs` (doc_id, text and the host's column).

    A null text has no word and fails; null hosts are one host. Repeated rows count each. More columns are ignored.
    """
    measure = F.pandas_udf(_measures, ", ".join(f"{m} long" for m in MEASURES))
    narrow = docs.select("doc_id", F.col(host).alias("host"), measure("text").alias("m"))
    measured = stored(narrow.select("doc_id", "host", "m.*"))
    verdicts = host_verdicts(measured).withColumnRenamed("host", "of")
    failed = F.expr(" OR ".join(RULES[r] for r in BASE))
    judged = measured.join(verdicts, F.col("host").eqNullSafe(F.col("of"))).withColumn("base_failed", failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("rejected")).alias("kept"),
    )


def oracle_sql() -> str:
    """The same rows, for DuckDB."""
    shrink = []
    for rule in RULES:
        mean, var = f"(SELECT coalesce(avg({rule} / n), 0) FROM hosts)", f"(SELECT coalesce(var_pop({rule} / n), 0) FROM hosts)"
        strength = (f"(SELECT least(greatest(CASE WHEN {var} = 0 THEN {STRENGTH[1]} ELSE {mean} * (1 - {mean}) / {var} - 1 END, "
                    f"{STRENGTH[0]}), {STRENGTH[1]}))")
        shrink.append(f"({rule} + {mean} * {strength}) / (n + {strength})")
    sums = ", ".join(f"sum(CAST({sql} AS BIGINT)) AS {rule}" for rule, sql in RULES.items())
    base = " OR ".join(RULES[r] for r in BASE)
    return f"""
    WITH texts AS (SELECT doc_id, source AS host, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
    words AS (SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY i) AS i FROM (
      SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM
        (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts))),
    windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
      SELECT r, i, word AS a, lead(word) OVER (PARTITION BY r ORDER BY i) AS b,
             lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM words) WHERE c IS NOT NULL),
    repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
    counted AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
    lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    measured AS (SELECT doc_id, host, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM texts LEFT JOIN counted USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
    hosts AS (SELECT host, count(*) AS n, {sums} FROM measured GROUP BY host),
    verdicts AS (SELECT host AS h, greatest({", ".join(shrink)}) > {REJECT_ABOVE} AS rejected FROM hosts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
           NOT ({base}) AND NOT rejected AS kept
    FROM measured JOIN verdicts ON host IS NOT DISTINCT FROM h"""
