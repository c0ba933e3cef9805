"""Training-data operators: scoring, tokenising, de-duplicating and filtering text corpora.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
