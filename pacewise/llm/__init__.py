"""Operators for large-scale training-data pipelines, and the queries that apply them to the given tables.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; ``queries.py`` registers one ``opN_<name>`` query per operator.
"""
