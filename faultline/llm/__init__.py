"""Operators for preparing training text: filters, joins, redaction, packing.

Nothing outside this subpackage imports it. Every operator takes DataFrames,
returns DataFrames and states its result for nulls, ties, repeated rows and
empty tables in its docstring.
"""
