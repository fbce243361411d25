"""Operators of a training-data pipeline: cleaning, near duplicates, mixing, packing, token files.

Nothing outside this package imports it. The registered queries are in
``revtext.llm.queries``.
"""
