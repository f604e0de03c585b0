"""Operators of a training-data pipeline (sharding, decontamination, scoring, tokenising, deduplication, ...).

Nothing outside this subpackage imports it except the guarded lines of
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
