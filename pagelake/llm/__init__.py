"""Operators of a training-data pipeline over tables of documents.

Nothing outside this subpackage imports it. Each operator is a function of a
DataFrame; ``queries`` holds the thin registered queries on top of them.
"""
