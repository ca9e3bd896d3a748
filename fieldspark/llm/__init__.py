"""Training-data operators: deduplication, scoring, extraction, mixing and packing of text corpora.

Each module holds one operator with a general interface; ``queries`` binds them to the synthetic tables.
Nothing outside this subpackage imports it.
"""
