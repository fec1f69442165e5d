"""Operations of a training-data pipeline.

Each module holds one operator with a general interface; ``queries`` derives the
digest rows of the registered queries from them.  Nothing outside this package
imports it.
"""
