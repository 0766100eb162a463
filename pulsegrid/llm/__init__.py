"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Each module holds one operator:
its general interface, and the thin query that applies it to a whole table.
"""
