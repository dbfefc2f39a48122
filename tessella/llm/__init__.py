"""Training-data operators: mixing, URL filters, media, toxicity, dedup, tokens, archives.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
