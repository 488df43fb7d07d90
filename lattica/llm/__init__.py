"""Training-data operators: dedup, filtering, scoring, packing and formatting of text corpora.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
