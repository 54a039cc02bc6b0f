"""Training-data operators (texts, pages, vectors, conversations) and their queries.

Nothing outside this folder imports it.  ``registry.QUERIES`` / ``registry.ORACLE``
hold the registered queries; every operator module documents its inputs, its
result for nulls, ties, repeated rows and empty tables, and its parameters.
"""
