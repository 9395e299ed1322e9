"""Operators for preparing training text, one module each.

Nothing else in the library imports this subpackage; its queries are listed
in :mod:`churnlens.llm.registry`.
"""
