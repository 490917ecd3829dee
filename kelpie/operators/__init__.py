"""DataFrame operators: scoring, joins, rollups, graph steps and ordered analytics."""
