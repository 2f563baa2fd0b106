"""Mentions and co-mentions that are computed once, stored by day, and reloaded."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aliases import AliasBook
from ..operators.comentions import edges_daily
from ..operators.mentions import mention_rows, mention_sets, scan_mentions
from ..sources.store import Materialised


class StoredAnalytics:
    """The derived tables of one archive and dictionary.

    The texts are read when the mentions are computed and at no other time: every series, total and
    edge follows from the stored mentions. `force` recomputes a table, `hold` keeps it in memory.
    """

    MENTIONS, EDGES = "mention_sets", "edges_daily"

    def __init__(
        self,
        tables: Materialised,
        messages: DataFrame,
        aliases: DataFrame | AliasBook,
        boundary: str = "word",
        exclude: str | None = None,
    ):
        self.tables = tables
        self.messages = messages
        self.aliases = aliases
        self.boundary = boundary
        self.exclude = exclude

    def _scan(self) -> DataFrame:
        scored = [c for c in ("day", "compound") if c in self.messages.columns]
        return mention_sets(scan_mentions(self.messages, self.aliases, self.boundary, scored))

    def mention_sets(self, force: bool = False, hold: bool = False) -> DataFrame:
        """message_id, day, compound if there is one, and `found`."""
        return self.tables.load(self.MENTIONS, self._scan, force, hold)

    def mention_rows(self, force: bool = False, hold: bool = False) -> DataFrame:
        """The same in long form."""
        return mention_rows(self.mention_sets(force, hold))

    def edges_daily(self, force_all: bool = False, force: bool = False, hold: bool = False) -> DataFrame:
        """Daily co-mention edges; `force_all` recomputes the mentions, too."""

        def build() -> DataFrame:
            return edges_daily(self.mention_sets(force_all, hold), self.exclude)

        return self.tables.load(self.EDGES, build, force_all or force, hold)
