"""Operators for building language-model training corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when the package is there.
"""
