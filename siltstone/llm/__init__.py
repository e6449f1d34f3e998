"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage: it can be deleted together
with its tests and with ``corpus_pipeline.py``.
"""
