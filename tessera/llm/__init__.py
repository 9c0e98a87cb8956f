"""Training-data operators: scoring, filtering, deduplication, mixing, packing.

Every module here stands alone on PySpark, numpy and pyarrow; nothing else in
the library imports this subpackage.
"""
