"""Training-data operators: text, page, vector and URL jobs over large corpora.

Nothing else in the library imports this package.
"""
