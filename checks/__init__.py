"""Registered queries with their SQL twins, over the given test tables."""
