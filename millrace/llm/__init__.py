"""Operators for preparing training data at scale.

Each module holds one operator with a general interface, and the query that
applies it to the test tables.  Nothing outside this package imports it.
"""
