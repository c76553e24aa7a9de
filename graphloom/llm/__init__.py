"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``graphloom.llm.catalog`` lists
its queries and their SQL.
"""
