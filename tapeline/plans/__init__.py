"""Plan shapes (prefix sums, joins, shared folders) and the query registry."""
