"""Unit-register analytics on Spark DataFrames.

Every operator is a plain function from DataFrames to a DataFrame, keyed by
``doc_id`` (and ``sheet`` where cells are involved), so one plan serves a whole
portfolio of documents.
"""
