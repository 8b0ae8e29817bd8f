"""Training-data operators: similarity joins, search, language, tokens, toxicity, extraction, mixing.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
