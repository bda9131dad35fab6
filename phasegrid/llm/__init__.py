"""Operators for training-data pipelines.

Nothing else in the package imports this subpackage.  ``QUERIES`` and ``SQL``
hold what ``__spark_entry__`` registers when the subpackage is present.
"""
