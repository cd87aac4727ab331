"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; its queries and oracle SQL are in
:mod:`plumbline.llm.registry`.
"""
