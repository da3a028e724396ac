"""DataFrame operators: dedup, joins, selection, validation and reports."""
