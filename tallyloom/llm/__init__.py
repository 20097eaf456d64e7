"""Operators for training-data pipelines over document, page, benchmark and vector tables.

Nothing else in the library imports this package; ``tallyloom.llm.queries`` registers its queries.
"""
