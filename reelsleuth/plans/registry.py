"""All queries and their SQL, by name."""

from __future__ import annotations

from . import digest_queries, episode_queries, media_queries, name_queries, ordered_queries, scalar_queries, season_queries, source_queries, spec_queries, state_queries, text_queries
from .base import ORACLES, QUERIES

MODULES = (digest_queries, episode_queries, media_queries, name_queries, ordered_queries, scalar_queries, season_queries, source_queries, spec_queries, state_queries, text_queries)
FLAGSHIP = "T08_transcript_place"

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
