"""All core queries by name, and their SQL."""

from __future__ import annotations

from presswork.plans import content, pages, relational, state

QUERIES = relational.QUERIES | content.QUERIES | state.QUERIES | pages.QUERIES
SQL = relational.SQL | content.SQL | state.SQL | pages.SQL
