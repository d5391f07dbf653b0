"""Training-data operators: archives, tokenisation, filters, near duplicates, scoring.

Nothing outside this subpackage imports it.
"""
