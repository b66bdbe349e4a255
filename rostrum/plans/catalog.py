"""Every query by name, and the SQL it is checked against."""

from __future__ import annotations

from rostrum.plans import briefs, civic, more, pipeline_queries, places, projects, space, texts

PARTS = (civic, texts, space, pipeline_queries, more, projects, places, briefs)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PARTS for k, v in p.ORACLES.items()}
