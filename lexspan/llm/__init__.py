"""Training-data operators: toxicity, token files, repetition rules, packing, mixing, near and exact
de-duplication, line de-duplication, page extraction and WARC archives.

Nothing outside this subpackage imports it.
"""
