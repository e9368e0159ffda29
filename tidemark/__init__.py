"""Spark operators over behavioural activity logs.

Every public operator is a function from DataFrames to a DataFrame, so it can
be chained with ``df.transform(...)``.  The canonical keys are ``unit``,
``period``, ``entity`` and an integer ``day``; ``tidemark.sources.activity``
maps any table onto them.
"""
