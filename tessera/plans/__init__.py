"""Syntax tree to DataFrame: predicates, aggregates, view rewrites."""
