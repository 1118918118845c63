"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; its queries are collected in
:mod:`sedimenta.llm.registry`.
"""
