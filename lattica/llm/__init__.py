"""Operators for preparing large language-model training corpora.

Nothing outside this package imports it; the query registry adds its queries only where it is present.
"""
