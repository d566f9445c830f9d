"""Operators of training-data pipelines over tables of texts, web pages and token ids.

Nothing else in the library imports this package.
"""
