"""Operators of a training-data pipeline: pages, documents and conversations in, decisions out.

Nothing outside this subpackage imports it.
"""
