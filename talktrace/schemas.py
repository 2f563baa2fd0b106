"""Table layouts: one specification per table, from which every schema and projection follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ColumnSpec:
    """A stored column, the source attribute it is filled from and its type."""

    name: str
    attribute: str | None
    type: str


# The column names and source attributes of the archive's four tables.
MESSAGE_COLUMNS = (
    ColumnSpec("CommentID", "id", "string"),
    ColumnSpec("PostID", None, "string"),
    ColumnSpec("permalink", "permalink", "string"),
    ColumnSpec("AuthorID", None, "string"),
    ColumnSpec("AuthorName", None, "string"),
    ColumnSpec("createdDate", "created_utc", "bigint"),
    ColumnSpec("body", "body", "string"),
    ColumnSpec("score", "score", "bigint"),
    ColumnSpec("parentID", "parent_id", "string"),
    ColumnSpec("insertionTimestamp", None, "bigint"),
)
THREAD_COLUMNS = (
    ColumnSpec("PostID", "id", "string"),
    ColumnSpec("name", "name", "string"),
    ColumnSpec("title", "title", "string"),
    ColumnSpec("permalink", "permalink", "string"),
    ColumnSpec("createdDate", "created_utc", "bigint"),
    ColumnSpec("AuthorID", None, "string"),
    ColumnSpec("AuthorName", None, "string"),
    ColumnSpec("isStickied", "stickied", "boolean"),
    ColumnSpec("linkFlairText", "link_flair_text", "string"),
    ColumnSpec("linkUrl", "url", "string"),
    ColumnSpec("isLocked", "locked", "boolean"),
    ColumnSpec("edited", "edited", "bigint"),
    ColumnSpec("numOfComments", "num_comments", "bigint"),
    ColumnSpec("selfText", "selftext", "string"),
    ColumnSpec("score", "score", "bigint"),
    ColumnSpec("upvoteRatio", "upvote_ratio", "double"),
    ColumnSpec("insertionTimestamp", None, "bigint"),
    ColumnSpec("isPoll", None, "boolean"),
)
POLL_COLUMNS = (
    ColumnSpec("PostID", None, "string"),
    ColumnSpec("totalVoteCount", "total_vote_count", "bigint"),
    ColumnSpec("votingEndTimestamp", "voting_end_timestamp", "bigint"),
    ColumnSpec("insertionTimestamp", None, "bigint"),
)
POLL_OPTION_COLUMNS = (
    ColumnSpec("PollOptionID", "id", "string"),
    ColumnSpec("PostID", None, "string"),
    ColumnSpec("text", "text", "string"),
    ColumnSpec("voteCount", "vote_count", "bigint"),
    ColumnSpec("insertionTimestamp", None, "bigint"),
)


@dataclass(frozen=True)
class TableSpec:
    """A stored table: its name, primary key and columns."""

    name: str
    key: str
    columns: tuple[ColumnSpec, ...]

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def ddl(self) -> str:
        return ", ".join(
            f"{c.name} {c.type}{' NOT NULL' if c.name == self.key else ''}" for c in self.columns
        )


# Table names and primary keys.
THREADS = TableSpec("Post", "PostID", THREAD_COLUMNS)
MESSAGES = TableSpec("Comment", "CommentID", MESSAGE_COLUMNS)
POLLS = TableSpec("Poll", "PostID", POLL_COLUMNS)
POLL_OPTIONS = TableSpec("PollOption", "PollOptionID", POLL_OPTION_COLUMNS)
ALL_TABLES = (THREADS, MESSAGES, POLLS, POLL_OPTIONS)

# The headers of the delimited inputs, and the shape of a submission.
MESSAGE_CSV = (
    "CommentID string, PostID string, permalink string, AuthorID string, AuthorName string, "
    "createdDate bigint, body string, score bigint, parentID string, insertionTimestamp bigint, "
    "compound double"
)
THREAD_CSV = ", ".join(f"{c.name} {c.type}" for c in THREAD_COLUMNS[:-1])
ROSTER_CSV = (
    "Islander string, Age int, Hometown string, ShowEntryDay int, ShowLeaveDay int, "
    "OnLeaveStatus string, MainVillaEntryDay int"
)
RAW_ROSTER_CSV = (
    "Islander string, Age string, Hometown string, Entered string, Status string"
)
TIMELINE_CSV = "Day int, Type string, Summary string, Islanders string"

_AUTHOR = "struct<id: string, name: string>"
SUBMISSION = (
    "id string, name string, title string, permalink string, created_utc bigint, "
    f"author {_AUTHOR}, stickied boolean, link_flair_text string, url string, locked boolean, "
    "edited bigint, num_comments bigint, selftext string, score bigint, upvote_ratio double, "
    f"comments array<struct<kind: string, id: string, permalink: string, author: {_AUTHOR}, "
    "created_utc: bigint, body: string, score: bigint, parent_id: string>>, "
    "poll_data struct<total_vote_count: bigint, voting_end_timestamp: bigint, "
    "options: array<struct<id: string, text: string, vote_count: bigint>>>"
)


# Where readers put the text of a record that does not fit its schema.
CORRUPT = "_corrupt"


def project_to(
    source: DataFrame, columns: tuple[ColumnSpec, ...], overrides: dict[str, Column] | None = None
) -> DataFrame:
    """Rename source attributes to stored columns; an override wins, a missing attribute is null."""
    overrides = overrides or {}
    present = set(source.columns)

    def value(spec: ColumnSpec) -> Column:
        if spec.name in overrides:
            filled = overrides[spec.name]
        elif spec.attribute in present:
            filled = F.col(f"`{spec.attribute}`")
        else:
            filled = F.lit(None)
        return filled.cast(spec.type).alias(spec.name)

    return source.select(*map(value, columns))
