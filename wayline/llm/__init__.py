"""Training-data operators for very large text corpora.

Nothing outside this folder imports it. Each module holds one operator with its general interface;
``queries`` holds the thin registered queries and their SQL.
"""
