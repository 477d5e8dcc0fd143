"""Training-data operators: near-dedup, decontamination, language ID, token files,
PII, exact search, WARC, packing, token counts and licence scans.

Nothing outside this subpackage imports it, except the entry point and the
corpus pipeline at the top of the repository.
"""
