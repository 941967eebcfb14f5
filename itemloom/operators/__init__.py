"""Relational operators: DataFrame(s) in, DataFrame out."""
