"""Sentiment: attribution to mentioned entities, and scoring texts with a lexicon.

A message's compound score counts once for each entity it mentions, however often.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import within_days
from .daily import _mark_picked, dense_series

# Fixed values of the published scoring rule: normalisation, negation factor, damping by distance.
NORMALISATION = 15.0
NEGATION_FACTOR = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
ROW_KEYS = 1024


def daily_sentiment(rows: DataFrame, mode: str = "mentioned") -> DataFrame:
    """Mean compound per day and entity, from mention rows that carry `compound`.

    `mentioned` averages over the messages that mention the entity. `zerofill` averages over all of
    the day's messages with any mention, those without the entity counting as 0.
    """
    if mode not in ("mentioned", "zerofill"):
        raise ValueError(f"mode must be 'mentioned' or 'zerofill', not {mode!r}")
    scored = F.col("compound").isNotNull()
    sums = rows.groupBy("day", "entity").agg(
        F.sum("compound").alias("total"),
        F.count("compound").alias("own_messages"),
        F.count_if(F.col("lead") & scored).alias("leads"),
    )
    if mode == "mentioned":
        base = F.col("own_messages")
    else:
        # Over the aggregate, so a day is no more rows than the dictionary has entities.
        base = F.sum("leads").over(Window.partitionBy("day"))
    mean = F.when(base > 0, F.coalesce(F.col("total"), F.lit(0.0)) / base).otherwise(F.lit(0.0))
    return sums.select("day", "entity", mean.alias("sentiment"))


def mean_sentiment(
    daily: DataFrame, picked: DataFrame, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Unweighted mean of the daily means over all active days of the range, quiet days being 0."""
    cells = dense_series(daily, picked, first, last, value="sentiment")
    return cells.groupBy("entity").agg(F.avg("value").alias("sentiment"))


def day_mean_sentiment(
    daily: DataFrame, picked: DataFrame, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Mean over the picked entities per active day; an entity without a mention counts as 0."""
    size = picked.agg(F.count_distinct("entity")).scalar()
    counted = F.when(F.col("is_picked"), F.col("sentiment")).otherwise(F.lit(0.0))
    return (
        _mark_picked(within_days(daily, first, last), picked)
        .groupBy("day")
        .agg(F.sum(counted).alias("total"))
        .select("day", (F.col("total") / size).alias("value"))
    )


def lexicon_sentiment(
    messages: DataFrame,
    lexicon: DataFrame,
    negations: Iterable[str] = (),
    boosters: Mapping[str, float] | None = None,
) -> DataFrame:
    """Score every message with a (token, valence) lexicon: neg, neu, pos and compound.

    A valence is strengthened or weakened by boosters among the three tokens before it, damped by
    distance, and reversed and reduced if a negation is among them. Each token travels with its
    three predecessors, so no window over the tokens of a message is needed. An inner join keeps the
    tokens of the lexicon alone; neutral ones are counted in the message's own row, which takes part in
    the join under one of ROW_KEYS keys that are no tokens, so that it is no hot key where the join is shuffled. What
    remains is folded to one small row per message.
    """
    boosters = dict(boosters or {})
    negations = list(negations)
    tokens = messages.select(
        "message_id", F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)).alias("tokens")
    )
    # Shifted copies, zipped: the surplus rows at the end of each message have no token.
    shifted = [F.concat(F.array(*[F.lit("")] * d), "tokens").alias(f"before_{d}") for d in (1, 2, 3)]
    none = F.lit(None).cast("string")
    own_key = F.concat(F.lit(" "), F.pmod(F.xxhash64("message_id"), F.lit(ROW_KEYS)).cast("string"))
    whole = F.struct(own_key.alias("token"), *[none.alias(f"before_{d}") for d in (1, 2, 3)])
    context = F.concat(F.array(whole), F.coalesce(F.arrays_zip(F.col("tokens").alias("token"), *shifted), F.array().cast(
        "array<struct<token: string, before_1: string, before_2: string, before_3: string>>")))
    size = F.coalesce(F.when(F.col("tokens").isNotNull(), F.size("tokens")), F.lit(0)).cast("bigint")
    placed = tokens.select("message_id", size.alias("size"), F.explode(context).alias("at")).select("message_id", "size", "at.*")
    scored_words = lexicon.where("token <> '' AND NOT startswith(token, ' ') AND valence <> 0").select("token", "valence")
    keys = messages.sparkSession.range(ROW_KEYS).select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("token"), F.lit(0.0).alias("valence"))
    known = placed.join(scored_words.unionByName(keys), "token")

    before = [F.coalesce(F.col(f"before_{d}"), F.lit("")) for d in (1, 2, 3)]
    push = F.lit(0.0)
    if boosters:
        strengths = F.create_map(*[F.lit(v) for entry in boosters.items() for v in entry])
        for previous, damping in zip(before, DISTANCE_DAMPING):
            strength = F.coalesce(F.try_element_at(strengths, previous), F.lit(0.0))
            push = push + strength * F.lit(damping)
    boosted = F.col("valence") + F.when(F.col("valence") < 0, -push).otherwise(push)
    negated = F.lit(False)
    if negations:
        for previous in before:
            negated = negated | previous.isin(negations)
    score = F.when(
        F.coalesce(F.col("valence"), F.lit(0.0)) != 0,
        F.when(negated, boosted * NEGATION_FACTOR).otherwise(boosted),
    ).otherwise(F.lit(0.0))

    scored = known.select("message_id", F.when(F.col("token").startswith(" "), F.col("size")).alias("size"), score.alias("s"))
    sums = scored.groupBy("message_id").agg(
        F.sum("s").alias("total"),
        F.sum(F.when(F.col("s") > 0, F.col("s") + 1).otherwise(F.lit(0.0))).alias("up"),
        F.sum(F.when(F.col("s") < 0, 1 - F.col("s")).otherwise(F.lit(0.0))).alias("down"),
        (F.sum("size") - F.count_if(F.col("s") != 0)).alias("flat"),
    )
    weight = F.col("up") + F.col("down") + F.col("flat")

    def share(part: str):
        return F.when(weight > 0, F.col(part) / weight).otherwise(F.lit(0.0))

    return sums.select(
        "message_id",
        share("down").alias("neg"),
        share("flat").alias("neu"),
        share("up").alias("pos"),
        (F.col("total") / F.sqrt(F.col("total") * F.col("total") + F.lit(NORMALISATION))).alias("compound"),
    )
