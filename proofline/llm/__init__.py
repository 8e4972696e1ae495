"""Operators for preparing large training corpora.

Nothing outside this folder imports it; ``queries.py`` registers the operators.
"""
