"""Operators for large text corpora: audio media, near-duplicates, tokens, fingerprints, HTML, toxicity, mixing, token files and URL rules.

Nothing outside this subpackage imports it. ``registry`` lists its queries and their SQL.
"""
