"""Operators for preparing text and vector corpora at scale.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
