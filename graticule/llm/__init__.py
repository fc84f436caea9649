"""Operators for building training corpora: mixing, scans, joins, classifiers and filters.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
