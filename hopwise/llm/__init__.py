"""Operators for large-scale training-data pipelines.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
