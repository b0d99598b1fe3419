"""Operators for large training-data corpora.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries.py`` derives the thin digest queries from them.
"""
