"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it: the entry module adds its queries
only when the subpackage can be imported.
"""
