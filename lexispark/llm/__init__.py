"""Training-data operators: language identification, filtering, deduplication,
scoring, mixing, WARC derivatives and subword encoding.

Nothing outside this subpackage imports it.
"""
