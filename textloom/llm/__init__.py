"""Training-data operators for language-model corpora.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
