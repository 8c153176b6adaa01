"""DataFrame operators (built-in expressions, joins, aggregates and windows only)."""
