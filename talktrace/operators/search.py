"""Ranked search over messages or threads: postings as a table, and BM25 over them.

A posting is a term's count in one text beside the text's length. One posting of each text leads, so that the
number of texts and their lengths follow from the postings, too: a search reads nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

# Fixed values of the published ranking: saturation of counts, share of the length normalisation.
SATURATION, LENGTH_SHARE = 1.2, 0.75
DIGITS = 6


def terms(text: str) -> Column:
    """Lower-case runs of letters, digits, underscores and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))


def postings(
    texts: DataFrame, key: str = "message_id", text: str = "body", carry: Sequence[str] = ("day",), only: Sequence[str] | None = None
) -> DataFrame:
    """term, key, carried columns, tf, length, lead of every distinct term of every text.

    `key` and the carried columns identify a text; texts without a term have no posting. With `only`, postings of
    other terms are left out unless they lead, which is all that a search for these terms reads.
    """
    cut = texts.select(key, *carry, terms(text).alias("terms"))
    # Spark computes what stands beside a generator for each of its rows, so a text's length and least term come first.
    sized = cut.select(key, *carry, "terms", F.size("terms").alias("length"), F.array_min("terms").alias("least"))
    own = F.when(F.size("terms") > 0, F.col("terms"))
    placed = sized.select(key, *carry, "length", "least", F.explode(own).alias("term"))
    if only is not None:
        placed = placed.where(F.col("term").isin(list(only)) | (F.col("term") == F.col("least")))
    counted = placed.groupBy("term", key, *carry, "length", "least").agg(F.count("*").alias("tf"))
    return counted.select("term", key, *carry, "tf", F.col("length").cast("bigint").alias("length"), (F.col("term") == F.col("least")).alias("lead"))


def search(found: DataFrame, queries: DataFrame, k: int = 10, key: str = "message_id") -> DataFrame:
    """query_id, rank, key, score: the k texts that suit each query (query_id, query) best, by BM25.

    `found` are postings. Scores are rounded, equal ones go to the smaller key. Terms of a query count once.
    The queries' terms are the small side: they are weighed and stored first, and postings of other terms are dropped where
    they are read. The rest is shuffled once, by text, before a posting is multiplied by the queries that hold its term: so
    scores are summed where they arise, and each task keeps no more than its k best of a query.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))
    wanted = found.join(asked.select("term").distinct(), "term", "left_semi")
    frequency = wanted.groupBy("term").agg(F.count("*").alias("df"))
    lead = F.when(F.col("lead"), F.col("length"))
    total, mean = found.agg(F.count(lead)).scalar(), found.agg(F.avg(lead)).scalar()
    rarity = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    full = tf + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("length") / mean)
    gain = rarity * tf * (SATURATION + 1) / full
    weighed = written(asked.join(frequency, "term"))
    by_text = found.select("term", key, "tf", "length").join(weighed.select("term").distinct(), "term", "left_semi").repartition(key)
    scored = by_text.join(weighed, "term").groupBy("query_id", key).agg(F.round(F.sum(gain), DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", key, "score")
