"""Language identification by bit-sliced Bloom filters of letter n-grams.

Each language has a Bloom filter of the n-grams that are typical of it. The filters are one table whose slots
hold a bit for each language, so the slots of an n-gram, combined by AND, give all languages that contain
it at once. A text's popcounts by language are corrected for the false positives that the fill of each
filter lets expect, and the language with the largest corrected count is chosen.

The filters are trained on all documents with a language. What is typical is judged by rates, so that the table's fixed
size serves a corpus of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SIZES = (3, 4)
SLOTS = 1 << 20
HASHES = 3
COUNTED_ROWS = 2000
LEAST_COUNT = 3
LEAST_SHARE = 0.5
LONG_ENOUGH = 50
UNKNOWN = "und"
_BLOCK = 1 << 20
_HELD = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_folded: np.ndarray | None = None


def _fold() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    global _folded
    if _folded is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            letter = chr(c)
            if letter.isalpha():
                low = letter.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded = table
    return _folded


def ngrams(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """64-bit codes of the letter n-grams of a whole text, with repeats; what is not a letter is a word end.

    All characters of an n-gram but its first and last are letters.
    """
    padded, found = f" {text} ", []
    for start in range(0, len(padded), _BLOCK):
        part = padded[start : start + _BLOCK + max(sizes) - 1]
        points = _fold()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        letters = np.concatenate([[0], np.cumsum(points != 32)])
        codes = points.astype(np.uint64)
        for n in range(2, min(max(sizes), len(points)) + 1):
            codes = codes[:-1] * np.uint64(_MULTIPLIERS[0]) + points[n - 1 :].astype(np.uint64) * np.uint64(2 * n + 1)
            if n in sizes:
                inner = letters[n - 1 : len(points)] - letters[1 : len(points) - n + 2]
                found.append((codes[inner == n - 2] if start + _BLOCK >= len(padded) else codes[:_BLOCK][inner[:_BLOCK] == n - 2]) ^ np.uint64(n))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def slots(codes: np.ndarray, number: int, size: int = SLOTS) -> np.ndarray:
    mixed = (codes ^ (codes >> np.uint64(29))) * np.uint64(_MULTIPLIERS[number + 1])
    return (mixed >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


class LanguageFilters:
    """The trained table: `names`, and a row of bytes for each slot with a bit for each name."""

    def __init__(self, names: list[str], table: np.ndarray, sizes: tuple[int, ...] = SIZES):
        self.names, self.table, self.sizes = names, table, sizes
        fill = np.zeros(table.shape[1] * 8)
        for i in range(table.shape[1]):
            fill[8 * i : 8 * i + 8] = np.bincount(table[:, i], minlength=256) @ _BITS
        self.false_rate = ((fill / len(table)) ** HASHES)[: len(names)]

    def contained(self, codes: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its filter contains."""
        masks = self.table[slots(codes, 0, len(self.table))]
        for i in range(1, HASHES):
            masks &= self.table[slots(codes, i, len(self.table))]
        counts = [np.bincount(masks[:, i], minlength=256) @ _BITS for i in range(masks.shape[1])]
        return np.concatenate(counts)[: len(self.names)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of all corrected counts; unknown, 0 without a letter or a language.

        Ties go to the name that is first in order. A text with letters always gets a learned language.
        """
        codes = ngrams(text or "", self.sizes)
        if not self.names or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0
        corrected = (self.contained(codes) - len(codes) * self.false_rate) / (1 - self.false_rate)
        corrected = np.clip(corrected, 0, None)
        best, total = int(corrected.argmax()), float(corrected.sum())
        return self.names[best], float(corrected[best] / total) if total else 0.0


def fold_of(doc_id: str = "doc_id") -> Column:
    """True for held-out documents: crc32 of the id as text, modulo 4, is 2; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tally(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its counts."""
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


class _Counts:
    """N-grams by language; texts wait until they have _HELD n-grams, which bounds what a task holds besides the distinct ones."""

    def __init__(self) -> None:
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.sizes: dict[str, int] = {}
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, lang: str, codes: np.ndarray) -> None:
        self.waiting.setdefault(lang, []).append(codes)
        self.sizes[lang] = self.sizes.get(lang, 0) + len(codes)
        if self.sizes[lang] >= _HELD:
            self.fold(lang)

    def fold(self, lang: str) -> None:
        fresh = np.unique(np.concatenate(self.waiting.pop(lang)), return_counts=True)
        self.sizes[lang] = 0
        self.known[lang] = tally(*zip(self.known[lang], fresh)) if lang in self.known else fresh

    def full(self) -> bool:
        return sum(len(codes) for codes, _ in self.known.values()) >= _HELD

    def drain(self):
        for lang in list(self.waiting):
            self.fold(lang)
        for lang, (codes, counts) in self.known.items():
            yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": counts})
        self.known = {}


def train(labeled: DataFrame) -> LanguageFilters:
    """Filters from all of `labeled` (doc_id, text, lang); rows with a null text or language are left out.

    An n-gram belongs to a language in which it occurs LEAST_COUNT times or more, in a language of more than COUNTED_ROWS
    documents as often for each so many of them, and, relative to all n-grams, at least LEAST_SHARE times as often as in the
    language where it is most frequent.
    """
    labeled = labeled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string"))
    rows = {r["lang"]: r["n"] for r in labeled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one for each language
    names = sorted(rows)
    width = max(1, -(-len(names) // 8))
    table = np.zeros((SLOTS, width), dtype=np.uint8)
    if not names:
        return LanguageFilters(names, table)
    least = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(LEAST_COUNT * max(1.0, rows[n] / COUNTED_ROWS)))])

    def grams(frames):
        counts = _Counts()
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                counts.add(lang, ngrams(text))
                if counts.full():
                    yield from counts.drain()
        yield from counts.drain()

    counted = labeled.select("lang", "text").mapInPandas(grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = counted.withColumn("rate", rate)
    typical = rated.withColumn("most", F.max("rate").over(Window.partitionBy("code"))).where(
        (F.col("n") >= least[F.col("lang")]) & (F.col("rate") >= LEAST_SHARE * F.col("most"))
    )

    def places(frames):
        for frame in frames:
            codes = frame["code"].to_numpy().view(np.uint64)
            bit = frame["lang"].map({n: i for i, n in enumerate(names)}).to_numpy()
            for i in range(HASHES):
                yield pd.DataFrame({"slot": slots(codes, i), "byte": bit // 8, "bits": 1 << (bit % 8)})

    placed = typical.select("lang", "code").mapInPandas(places, "slot long, byte long, bits long")
    filled = placed.groupBy("slot", "byte").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most one row for each slot and byte
    table[filled["slot"].to_numpy(), filled["byte"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint8)
    return LanguageFilters(names, table)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang; more columns are ignored).

    Trained on rows that are not held out; predictions use the text alone. A null text, or one without a
    letter, gets the unknown language and score 0, as does every row if no language can be learned.
    """
    filters = docs.sparkSession.sparkContext.broadcast(train(docs.where(~fold_of())))  # SLOTS bytes for 8 languages

    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([filters.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = F.pandas_udf(predict, "lang_pred string, score double")
    return docs.select("doc_id", fold_of().alias("held_out"), found("text").alias("p")).select("doc_id", "held_out", "p.*")


def evidence(filters: LanguageFilters, text: str) -> tuple[int, float]:
    """How many n-grams a text has, and the best language's corrected count as a share of them."""
    codes = ngrams(text, filters.sizes)
    corrected = (filters.contained(codes) - len(codes) * filters.false_rate) / (1 - filters.false_rate)
    return len(codes), float(corrected.max(initial=0)) / max(1, len(codes))


def least_evidence(labeled: DataFrame, filters: LanguageFilters) -> float:
    """The share of known n-grams below which a text is in no learned language.

    Half of what all but one in a thousand of the training documents have, of those long enough to tell.
    """
    able = labeled.where("lang IS NOT NULL AND text IS NOT NULL")
    if not filters.names:
        return 0.0

    @F.pandas_udf("double")
    def shares(texts: pd.Series) -> pd.Series:
        found = [evidence(filters, t) for t in texts]
        return pd.Series([s if n >= LONG_ENOUGH else None for n, s in found], dtype=float)

    low = able.select(shares("text").alias("share")).where("share IS NOT NULL AND NOT isnan(share)").agg(
        F.percentile_approx("share", 0.001, 10_000)).first()[0]
    return 0.5 * (low or 0.0)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are in a language, unchanged.

    Null texts and texts without a letter go. So do texts of which no n-gram is known beyond what false
    positives explain, and longer ones whose share of known n-grams is below `least_evidence`. Where no language
    can be learned, all texts with a letter stay. Repeated rows are judged alike; an empty table gives no rows.
    """
    labeled = docs.where(~fold_of())
    learned = train(labeled)
    least = least_evidence(labeled, learned)
    filters = docs.sparkSession.sparkContext.broadcast(learned)

    def told(text: str | None) -> bool:
        known = filters.value
        if not any(map(str.isalpha, text or "")):
            return False
        if not known.names:
            return True
        n, share = evidence(known, text)
        return share > 0 and (n < LONG_ENOUGH or share >= least)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return pd.Series([told(t) for t in texts], dtype=bool)

    return docs.where(keeps("text"))
