"""Training-data operators: filters, classifiers, near-duplicates, tokenisation.

Nothing outside this folder imports it.
"""
