"""Operators for training-data pipelines over ``documents``, ``pages`` and ``benchmark``.

One module per operator; ``queries`` holds the registered queries.  Nothing
else in the package imports from here.
"""
