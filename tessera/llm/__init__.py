"""Training-data operators for large text corpora.

Nothing else in the library imports this subpackage.  ``registry`` lists its queries.
"""
