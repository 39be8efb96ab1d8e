"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  Every operator works on the columns it is told to use, under internal
names of its own, so extra or clashing column names in the input do no harm.
"""
