"""Small tables with the cases every corpus operator must stand, and readers of the given ones."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EDGE_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 40, "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog. " * 40, "en", "a"),  # exact copy
    (3, "The quick brown fox jumps over the lazy dog. " * 39 + "The end of it.", "en", None),  # near copy
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \t\n\x0b\x0c\r", None, None),
    (7, "word", "fr", "c"),
    (8, "ÀÉ ça été déjà vu ; l'œuvre 東京 😀 naïve " * 30, "fr", "c"),
    (9, "x" * 300_000, "en", "a"),
    (10, "long words of many kinds number " + " ".join(f"w{i}" for i in range(30_000)), "en", "a"),
    (11, "Mail a.b@c.example.com or call +1 (368) 555-0098, card 4539578763621486, at 10.0.0.255.\nUnder the MIT License.", "en", "b"),
    (11, "Mail a.b@c.example.com or call +1 (368) 555-0098, card 4539578763621486, at 10.0.0.255.\nUnder the MIT License.", "en", "b"),
    (None, "A row without an id but with words enough to be counted.", "en", "b"),
    (12, "12345 67890 !!! ???", "de", "d"),
]


def edge_docs(spark, rows=None, extra=()):
    """The edge cases with the columns of documents, and more columns of the given names."""
    rows = EDGE_TEXTS if rows is None else rows
    columns = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([r[2] for r in rows], pa.string()),
        "source": pa.array([r[3] for r in rows], pa.string()),
        "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64()),
    }
    for name in extra:
        columns[name] = pa.array(["clash"] * len(rows), pa.string())
    return spark.createDataFrame(pa.table(columns))


def documents(sf: str = SF) -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
