"""Operators for training-data pipelines over documents, vectors and conversations.

Each operator is one module with a general interface and a thin ``query`` that applies it
to its whole table; ``registry`` collects the queries and their SQL.
"""
