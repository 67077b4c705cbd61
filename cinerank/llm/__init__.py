"""Operators for preparing training text, each a Spark job over whole tables.

Nothing else in the library imports this package.
"""
