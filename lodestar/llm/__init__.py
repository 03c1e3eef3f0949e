"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; the queries that apply the
operators to the driver's tables are in :mod:`lodestar.llm.queries`.
"""
