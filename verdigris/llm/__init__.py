"""Operators for preparing large-scale training data.

Nothing outside this subpackage imports it; its queries and their SQL live in
``verdigris.llm.queries``.
"""
