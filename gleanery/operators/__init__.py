"""Operators over DataFrames: predicates, deduplication, relations, joins, selection, clustering."""
