"""Operators for large-scale training-data preparation.

Each module holds one operator with its own interface; :mod:`.queries` applies
them to the standard tables.  Nothing outside this subpackage imports it.
"""
