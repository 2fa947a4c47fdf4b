"""Training-data operators: tokens, toxicity, near-duplicates, mixing, licences,
quality, secrets, line de-duplication, exact top-k and chat formatting.

Nothing outside this subpackage imports it.
"""
