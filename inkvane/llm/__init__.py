"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``corpus_pipeline.py`` at the
repository top and ``tests/llm`` belong to it.
"""
