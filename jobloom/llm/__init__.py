"""Operators for large training-data pipelines.

Each module holds one operator with a general interface over any DataFrame
with an id and a text column; ``llm.queries`` binds them to the ``documents``
table.  Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
