"""Small categorical derivations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The thread types, the texts that decide them, the status that marks an eliminated
# entity, and the name of the cross-entity mean series.
MID_MARK = "Daily Discussion"
POST_MARK = "post"
ELIMINATED = "Dumped"
AVERAGE = "Average"


def thread_type(title: Column) -> Column:
    """MID wins over POST; everything else is PRE. Only the POST test ignores case."""
    return (
        F.when(title.contains(MID_MARK), F.lit("MID"))
        .when(F.lower(title).contains(POST_MARK), F.lit("POST"))
        .otherwise(F.lit("PRE"))
    )


def sentiment_label(compound: Column, negative: float, positive: float) -> Column:
    """-1, 0 or 1; where both limits apply, the positive one decides."""
    return (
        F.when(compound >= F.lit(positive), F.lit(1))
        .when(compound <= F.lit(negative), F.lit(-1))
        .otherwise(F.lit(0))
    )


def short_label(name: Column) -> Column:
    """The first token of a name."""
    return F.split(name, " ")[0]
