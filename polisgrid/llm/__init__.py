"""Training-data operators: tokens, near-duplicates, secrets, models of text.

Nothing outside this subpackage imports it.
"""
