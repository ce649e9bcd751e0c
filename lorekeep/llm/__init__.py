"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``lorekeep.llm.queries`` holds the
query registry; ``__spark_entry__`` adds it when the subpackage is present.
"""
