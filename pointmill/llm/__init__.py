"""Operators for building training corpora: ten operators, their queries and the corpus pipeline's parts.

Nothing else in the library imports this subpackage.
"""
