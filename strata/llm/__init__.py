"""Training-data operators: ten corpus operators, their queries, and shared helpers.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin registered
queries that apply them to the given tables.
"""
