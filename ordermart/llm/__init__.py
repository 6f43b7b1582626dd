"""Operators for preparing training text at scale.

One module per operator, each with its general interface; ``queries.py`` holds
the registered queries. Nothing outside this package imports it.
"""
