"""Operators for building training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``registry`` holds the queries and their SQL.
"""
