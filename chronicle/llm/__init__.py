"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it.  Every module has an operator with
a general interface and an ``opN_*`` query that applies it to a whole table.
"""
