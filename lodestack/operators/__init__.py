"""DataFrame operators: identity, classification, joins, aggregates, ranking, sets and the capture log."""
