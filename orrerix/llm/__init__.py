"""Operators of a training-data pipeline: one module for each, queries and SQL in ``queries``.

Nothing else in the package imports this subpackage.  On a cluster the package
reaches the executors with ``--py-files`` or the image, as any other library.
"""
