"""A PySpark engine for page-oriented documents: decoding, geometry, words, text and tables as DataFrames."""
