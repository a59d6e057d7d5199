"""Corpus operators for large training-text collections.

One module for each operator; ``queries`` has the thin queries and their SQL.
Nothing outside this subpackage imports it.
"""
