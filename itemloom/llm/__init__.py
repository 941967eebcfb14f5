"""Operators for preparing training text: encoding, mixing, filters, duplicate search, scoring.

Nothing else in the library imports this package; ``queries.py`` registers its queries.
"""
