"""Operators for training-data pipelines: filters, near copies, mixing, search and token files.

Nothing outside this folder imports it; ``llm.queries`` holds its registered queries.
"""
