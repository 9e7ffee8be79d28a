"""Operators of a training-data pipeline: one module per operator, their queries in ``queries``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
