"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it can be imported.
"""
