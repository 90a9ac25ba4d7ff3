"""Relational and ordered operators: DataFrame in, DataFrame out."""
