"""Operators of a training-data pipeline over documents and pages.

Nothing outside this subpackage imports it, apart from the guarded registration of its
queries and the pipeline at the top of the repository.
"""
