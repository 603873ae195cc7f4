"""Operators for preparing large training corpora.

Every module is a DataFrame-in / DataFrame-out operator. Nothing outside this
subpackage imports it.
"""
