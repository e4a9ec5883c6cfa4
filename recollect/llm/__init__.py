"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames; nothing outside this package imports it.
``queries`` holds the registered ``opN_*`` queries and their SQL.
"""
