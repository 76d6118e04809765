"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; removing the folder leaves the name
resolution engine intact.
"""
