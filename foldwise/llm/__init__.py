"""Operators for preparing training corpora (text, pages, vectors).

Nothing else in the library imports this subpackage.
"""
