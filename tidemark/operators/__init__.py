"""DataFrame operators: routing, joins, state machines, enrichment and upserts."""
