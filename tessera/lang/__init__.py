"""The pipeline query language: tokens, syntax tree, parser."""

from tessera.lang.parser import QueryError, parse

__all__ = ["QueryError", "parse"]
