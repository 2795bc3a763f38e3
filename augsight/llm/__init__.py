"""Operators for large training-data pipelines; queries and their SQL are in :mod:`augsight.llm.queries`."""
