"""Operators that prepare language-model training data.

Every module holds one operator with a general interface; ``queries.py`` binds
them to the test tables.  Nothing outside this subpackage imports it.
"""
