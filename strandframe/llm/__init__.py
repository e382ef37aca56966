"""Operators for large text corpora: sketches, classifiers, tokenisation, packing, search and joins.

Nothing outside this package imports it. ``registry`` holds the queries and their SQL.
"""
