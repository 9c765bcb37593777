"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns
DataFrames; the thin ``opN_*`` queries that apply them to whole tables live in
:mod:`pellucid.llm.registry`.
"""
