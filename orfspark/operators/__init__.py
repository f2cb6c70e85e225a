"""Filters, joins, aggregations, windows and models over evidence tables."""
