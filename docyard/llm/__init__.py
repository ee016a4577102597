"""Operators of a training-data pipeline: search, filtering, dedup, packing, tokenising, extraction.

Nothing else in the library imports this package; ``__spark_entry__.py`` adds its
queries when it can be imported. Only general helpers (session, lineage cuts) come
from outside.
"""
