"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from . import facts, nested, pipeline, reporting, scanning, screening

FLAGSHIP = screening.ranked_candidates
QUERIES = {**screening.QUERIES, **nested.QUERIES, **scanning.QUERIES, **facts.QUERIES, **reporting.QUERIES, **pipeline.QUERIES}
SQL = {**screening.SQL, **nested.SQL, **scanning.SQL, **facts.SQL, **reporting.SQL, **pipeline.SQL}
