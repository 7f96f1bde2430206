"""Operators for preparing training corpora.

Nothing outside this folder imports it; the folder can be removed and the rest of the library still works.
"""
