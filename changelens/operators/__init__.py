"""Transformations and analyses of change tables: DataFrame in, DataFrame out."""
