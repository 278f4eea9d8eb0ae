"""Operators for large text and vector corpora (training-data preparation).

Every module holds one operator with its own interface; ``queries`` wires them to
the driver tables.  Nothing outside this subpackage imports it.
"""
